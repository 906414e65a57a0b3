"""Signature rules for licence notices, in order of family. Patterns run over lower-cased words joined by one space.

RULES: label, score, keyword, pattern. A rule is tried only where its keyword occurs; its priority is its place.
"""

#: Base phrases (words that stand consecutively) and their labels: given, never suppressed.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

V = r"(?: version| ver| v)?"
LATER = r"(?: or(?: any)? later(?: version)?)?"
#: label | keyword | patterns for notices, grants and titles, the most specific first, separated by " || "
FAMILIES = """
agpl-3.0 | affero | gnu affero general public license{v} 3(?: 0)?{later} || agpl ?v? ?3(?: 0)?(?: only| or later)? || affero general public license{v} 3
agpl-1.0 | affero | affero general public license{v} 1(?: 0)?{later} || agpl ?v? ?1(?: 0)?(?: only| or later)?
agpl | affero | gnu affero general public license || affero gpl
lgpl-3.0 | lesser | (?:gnu )?lesser general public license{v} 3(?: 0)?{later} || lesser gpl{v} 3
lgpl-2.1 | lesser | (?:gnu )?lesser general public license{v} 2 1{later} || lesser gpl{v} 2 1
lgpl-2.0 | library general | (?:gnu )?library general public license{v} 2(?: 0)?{later} || library gpl{v} 2
lgpl | lesser | (?:gnu )?lesser general public license || lesser gpl
lgpl | library general | (?:gnu )?library general public license
gpl-3.0-or-later | general public | (?:gnu )?general public license{v} 3(?: 0)? or(?: at your option)?(?: any)? later(?: version)? || general public license as published by the free software foundation either version 3 of the license or
gpl-2.0-or-later | general public | (?:gnu )?general public license{v} 2(?: 0)? or(?: at your option)?(?: any)? later(?: version)? || general public license as published by the free software foundation either version 2 of the license or
gpl-3.0 | general public | (?:gnu )?general public license{v} 3(?: 0)? || version 3 of the (?:gnu )?general public license
gpl-2.0 | general public | (?:gnu )?general public license{v} 2(?: 0)? || version 2 of the (?:gnu )?general public license
gpl-1.0 | general public | (?:gnu )?general public license{v} 1(?: 0)? || version 1 of the (?:gnu )?general public license
gpl-with-classpath | classpath exception | general public license(?: version 2)? with(?: the)? classpath exception || gpl 2 0 with classpath exception
gpl | general public | gnu general public license || terms of the general public license
gpl-3.0 | gpl | gnu gpl ?v? ?3(?: 0)? || gplv3\\+? || licensed under(?: the)? gpl ?v? ?3(?: 0)?
gpl-2.0 | gpl | gnu gpl ?v? ?2(?: 0)? || gplv2\\+? || licensed under(?: the)? gpl ?v? ?2(?: 0)?
gpl | gpl | gnu gpl || licensed under(?: the)? gpl
gfdl-1.3 | free documentation | (?:gnu )?free documentation license{v} 1 3{later}
gfdl-1.2 | free documentation | (?:gnu )?free documentation license{v} 1 2{later}
gfdl-1.1 | free documentation | (?:gnu )?free documentation license{v} 1 1{later}
gfdl | free documentation | (?:gnu )?free documentation license
apache-2.0 | apache | licensed under the apache license{v} 2(?: 0)? || apache license{v} 2(?: 0)? || apache software license{v} 2(?: 0)? || apache 2(?: 0)? license
apache-1.1 | apache | apache(?: software)? license{v} 1 1
apache-1.0 | apache | apache(?: software)? license{v} 1(?: 0)?
apache | apache | apache software license || (?:under|of) the apache license
mit | mit | (?:released|licensed|distributed|available) under the mit license || the mit license mit || mit licensed? || the mit license
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0 | mit no | mit no attribution(?: license)?
expat | expat | (?:the )?expat license
x11 | x11 | x11 license || mit x11 license || x consortium license
isc | isc | (?:the )?isc license || licensed under the isc
isc | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)?
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?
bsd-0-clause | bsd | (?:bsd zero clause|zero clause bsd|0bsd)(?: license)?
bsd | bsd | bsd style license || bsd licensed? || licensed under(?: the)? bsd
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
mpl-2.0 | mozilla | mozilla public license{v} 2(?: 0)? || terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | mozilla public license{v} 1 1
mpl-1.0 | mozilla | mozilla public license{v} 1(?: 0)?
mpl | mozilla | mozilla public license
epl-2.0 | eclipse | eclipse public license{v} 2(?: 0)?
epl-1.0 | eclipse | eclipse public license{v} 1(?: 0)?
epl | eclipse | eclipse public license || eclipse distribution license
eupl-1.2 | european union public | european union public licen[cs]e{v} 1 2
eupl-1.1 | european union public | european union public licen[cs]e{v} 1 1
eupl | european union public | european union public licen[cs]e
cddl-1.1 | common development | common development and distribution license{v} 1 1
cddl-1.0 | common development | common development and distribution license(?:{v} 1(?: 0)?)?
cpl-1.0 | common public | common public license(?:{v} 1(?: 0)?)?
ipl-1.0 | ibm public | ibm public license(?:{v} 1(?: 0)?)?
ms-pl | microsoft public | microsoft public license(?: ms pl)?
ms-rl | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
artistic-2.0 | artistic | artistic license{v} 2(?: 0)?
artistic-1.0 | artistic | artistic license{v} 1(?: 0)?
artistic | artistic | artistic license || same terms as perl itself
bsl-1.0 | boost | boost software license(?:{v} 1(?: 0)?)?
busl-1.1 | business source | business source license(?:{v} 1 1)?
sspl-1.0 | server side public | server side public license(?:{v} 1)?
elastic-2.0 | elastic license | elastic license(?:{v} 2(?: 0)?)?
zlib | zlib | zlib license || zlib libpng license || licensed under the zlib
zlib | provided as is without | this software is provided as is without any express or implied warranty
libpng | libpng | libpng license(?:{v} 2)?
unlicense | unlicense | the unlicense || unlicense license
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | want to public license | do what the f\\w+ you want to public license
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons zero | creative commons zero(?:{v} 1(?: 0)?)?
pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication and licen[cs]e
odbl-1.0 | open database | open database licen[cs]e(?:{v} 1(?: 0)?)?
odc-by-1.0 | open data commons | open data commons attribution licen[cs]e
ogl-3.0 | open government | open government licen[cs]e{v} 3(?: 0)?
ogl | open government | open government licen[cs]e
public-domain | public domain | (?:dedicated to|placed in|released into|released to|is in) the public domain
ofl-1.1 | open font | (?:sil )?open font license(?:{v} 1 1)?
lppl-1.3c | latex project | latex project public license(?:{v} 1 3c?)?
php-3.01 | php license | php license{v} 3 0?1
php | php license | php license
python-2.0 | python software foundation | python software foundation license(?:{v} 2)?
psf | psf license | psf license
ruby | ruby license | ruby license || same terms as ruby
openssl | openssl | openssl license
postgresql | postgresql | postgresql licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa open source license
afl-3.0 | academic free | academic free license(?:{v} 3(?: 0)?)?
osl-3.0 | open software license | open software license(?:{v} 3(?: 0)?)?
upl-1.0 | universal permissive | universal permissive license(?:{v} 1(?: 0)?)?
unicode | unicode license | unicode license(?: v3| agreement)?
w3c | w3c software | w3c software(?: notice and)? license
cecill-2.1 | cecill | cecill(?: free software license)?(?: agreement)?{v} 2(?: [01])?
cecill | cecill | cecill license
qpl-1.0 | q public | q public license(?:{v} 1(?: 0)?)?
sleepycat | sleepycat | sleepycat license
vim | vim license | vim license
beerware | beer ware | beer ware license
json | not evil | shall be used for good not evil
aal | attribution assurance | attribution assurance license
apsl-2.0 | apple public source | apple public source license{v} 2(?: 0)?{later}
apsl-1.2 | apple public source | apple public source license{v} 1 2
apsl | apple public source | apple public source license
bittorrent-1.1 | bittorrent | bittorrent open source license(?:{v} 1 1)?
blueoak-1.0.0 | blue oak | blue oak model license(?:{v} 1(?: 0)*)?
bsd-1-clause | bsd | (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-3-clause | neither the name | neither the name of(?: the)?(?: \\w+){1,8} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg
bsd-3-clause-clear | clear bsd | (?:bsd 3 clause clear|clear bsd) license
cpal-1.0 | common public attribution | common public attribution license(?:{v} 1(?: 0)?)?
curl | curl license | (?:the )?curl license
catosl-1.1 | computer associates | computer associates trusted open source license(?:{v} 1 1)?
cecill-b | cecill b | cecill b(?: free software)? license
cecill-c | cecill c | cecill c(?: free software)? license
commons-clause | commons clause | commons clause(?: license)?(?: condition)?{v}?(?: 1(?: 0)?)? || subject to the commons clause
confluent | confluent community | confluent community license(?: agreement)?(?:{v} 1(?: 0)?)?
cua-opl-1.0 | cua office | cua office public license(?:{v} 1(?: 0)?)?
dsl | design science | design science license
ecl-2.0 | educational community | educational community license(?:{v} 2(?: 0)?)?
ecl-1.0 | educational community | educational community license{v} 1(?: 0)?
efl-2.0 | eiffel forum | eiffel forum license(?:{v} 2)?
entessa | entessa public | entessa public license
erlpl-1.1 | erlang public | erlang public license(?:{v} 1 1)?
eudatagrid | eu datagrid | eu datagrid software license
fair | fair license | (?:the )?fair license
fal-1.3 | free art | free art license(?:{v} 1 3)? || licence art libre
frameworx-1.0 | frameworx | frameworx open license(?:{v} 1(?: 0)?)?
fsl | functional source | functional source license(?:{v} 1 1)?
ftl | freetype | freetype(?: project)? license
gnu-all-permissive | without royalty | copying and distribution of this file with or without modification are permitted in any medium without royalty
hpnd | historical permission | historical permission notice and disclaimer
ijg | independent jpeg | independent jpeg group(?: s)?(?: software)? license
imagemagick | imagemagick | imagemagick license
imlib2 | imlib2 | imlib2 license
info-zip | info zip | info zip license
intel | intel open source | intel open source license
ipa | ipa font | ipa font license
jython | jython | jython license
liliq-p-1.1 | liliq | licence libre du quebec permissive || liliq p(?: 1 1)?
lpl-1.02 | lucent public | lucent public license(?:{v} 1 0?2)?
lsof | lsof license | lsof license
miros | miros | (?:the )?miros licen[cs]e
motosoto | motosoto | motosoto open source license
mulanpsl-2.0 | mulan | mulan p(?:ermissive s(?:oftware l(?:icense)?)?|sl)(?:{v} 2(?: 0)?)?
multics | multics | multics license
nasa-1.3 | nasa open source | nasa open source agreement(?:{v} 1 3)?
naumen | naumen public | naumen public license
net-snmp | net snmp | net snmp license
netcdf | netcdf | netcdf license
nokia | nokia open source | nokia open source license
nosl | netizen | netizen open source license
nposl-3.0 | non profit open software | non profit open software license(?:{v} 3(?: 0)?)?
ntp | ntp license | (?:the )?ntp license
oclc-2.0 | oclc research | oclc research public license(?:{v} 2(?: 0)?)?
oldap-2.8 | openldap | openldap public license{v} 2 8
oldap | openldap | openldap public license
opl-1.0 | open publication | open publication license(?:{v} 1(?: 0)?)?
oset-pl-2.1 | oset public | oset public license(?:{v} 2 1)?
parity | parity public | parity public license(?:{v} [67](?: 0)*)?
polyform-noncommercial | polyform noncommercial | polyform noncommercial license(?: 1(?: 0)*)?
polyform-small-business | polyform small | polyform small business license(?: 1(?: 0)*)?
polyform | polyform | polyform (?:shield|perimeter|strict|internal use|free trial) license(?: 1(?: 0)*)?
prosperity | prosperity public | prosperity public license(?:{v} [23](?: 0)*)?
rpl-1.5 | reciprocal public | reciprocal public license(?:{v} 1 5)?
rpsl-1.0 | realnetworks | realnetworks public source license(?:{v} 1(?: 0)?)?
rscpl | ricoh source | ricoh source code public license
rsal | redis source available | redis source available license(?:{v} 2)?
simpl-2.0 | simple public | simple public license(?:{v} 2(?: 0)?)?
sissl | sun industry | sun industry standards source license
spl-1.0 | sun public | sun public license(?:{v} 1(?: 0)?)?
ssleay | ssleay | (?:original )?ssleay license
sugarcrm-1.1.3 | sugarcrm | sugarcrm public license(?:{v} 1 1 3)?
sustainable-use | sustainable use | sustainable use license(?:{v} 1(?: 0)?)?
tcl | tcl tk | tcl tk license
tosl | trusster | trusster open source license
uoi-ncsa | university of illinois | university of illinois ncsa license
vsl-1.0 | vovida | vovida software license(?:{v} 1(?: 0)?)?
watcom-1.0 | watcom | sybase open watcom public license(?:{v} 1(?: 0)?)?
wxwindows | wxwindows | wxwindows library licen[cs]e(?:{v} 3 1)?
xnet | x net license | x net license
zpl-2.1 | zope | zope public license{v} 2 1
zpl | zope | zope public license
ogl-uk-2.0 | open government | uk open government licen[cs]e{v} 2(?: 0)?
etalab-2.0 | licence ouverte | licence ouverte(?: open licence)?(?:{v} 2(?: 0)?)?
dl-de-by-2.0 | datenlizenz deutschland | datenlizenz deutschland namensnennung(?:{v} 2(?: 0)?)?
dl-de-zero-2.0 | datenlizenz deutschland | datenlizenz deutschland zero(?:{v} 2(?: 0)?)?
cdla-permissive-2.0 | community data license | community data license agreement permissive(?:{v} [12](?: 0)?)?
cdla-sharing-1.0 | community data license | community data license agreement sharing(?:{v} 1(?: 0)?)?
gemma | gemma terms | gemma terms of use
no-warranty | without warranty | without warranty of any kind(?: express or implied)?
non-commercial | commercial | for non ?commercial (?:use|purposes) only || not for commercial use
no-redistribution | redistribut | (?:may|must) not be redistributed
permission | permission | (?:used|reprinted|reproduced) with(?: the)?(?: kind)? permission(?: of)?
patent | patent | (?:u s )?patents? pending
trademark | trademark | (?:is|are)(?: a)?(?: registered)? trademarks?(?: of(?: \\w+){1,3})?
llama | llama | llama [23](?: [0-9])? community license
openrail | rail | (?:creative ml |bigscience |big code )?open ?rail(?: ?\\+\\+)?(?: m)?(?: license)?
rail | responsible ai | responsible ai licen[cs]e
proprietary | confidential | proprietary and confidential || confidential and proprietary
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? (?:of this \\w+ |is )?(?:strictly )?prohibited
reserved | rights reserved | all rights reserved || all rights are reserved || some rights reserved
reserved | without permission | (?:may|must) not be (?:reproduced|copied|distributed)(?: \\w+){0,6} without(?: \\w+){0,4} permission
copyright | copyright | copyright(?: c)?(?: by)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: \\w+)?
terms | terms of | (?:see|under) the terms of (?:use|service)
"""

#: Creative Commons: every kind in full words and in letters, with and without a version.
CREATIVE_COMMONS = """
cc-by-nc-nd | by nc nd | attribution non ?commercial no ?deriv(?:ative|ative work)?s
cc-by-nc-sa | by nc sa | attribution non ?commercial share ?alike
cc-by-nc | by nc | attribution non ?commercial
cc-by-nd | by nd | attribution no ?deriv(?:ative|ative work)?s
cc-by-sa | by sa | attribution share ?alike
cc-by | by | attribution
"""

#: Identifiers of the public list of licence identifiers that may follow "spdx license identifier".
SPDX = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1
apache-2.0 apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause
bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5
cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0
cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.0
cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eudatagrid eupl-1.0 eupl-1.1
eupl-1.2 fair frameworx-1.0 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0
gpl-3.0-only gpl-3.0-or-later hpnd ipa ipl-1.0 isc json lgpl-2.0 lgpl-2.0-only lgpl-2.1 lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng-2.0 lppl-1.3c miros mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0
ms-pl ms-rl mulanpsl-2.0 ncsa nokia ntp odbl-1.0 odc-by-1.0 ofl-1.1 ogl-uk-3.0 openssl osl-3.0 pddl-1.0 php-3.01
postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib
"""


#: Labels of notices that name no licence: their rules score less.
WEAK = {"copyright", "terms", "no-warranty", "no-redistribution", "permission", "patent", "trademark"}


def rules() -> list[tuple[str, float, str, str]]:
    """All rules in order of priority."""
    out = [
        (name, 1.0, "spdx", r"spdx license identifier " + name.replace(".", " ").replace("-", " ?"))
        for name in sorted(SPDX.split(), key=len, reverse=True)
    ]
    for line in FAMILIES.strip().splitlines():
        label, keyword, patterns = (part.strip() for part in line.split(" | "))
        for k, pattern in enumerate(patterns.split(" || ")):
            filled = pattern.replace("{v}", V).replace("{later}", LATER).replace("\\\\", "\\")
            out.append((label, 0.6 if label in WEAK else 0.9 - 0.05 * k, keyword, filled))
    for line in CREATIVE_COMMONS.strip().splitlines():
        label, letters, words = (part.strip() for part in line.split(" | "))
        out.append((label, 0.95, "creative commons", rf"creative commons {words}(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"))
        out.append((label, 0.9, "cc " + letters, rf"cc {letters}(?: [1-4] [05])?(?: license)?"))
        out.append((label, 0.85, "creativecommons", rf"creativecommons org licenses {letters}(?: [1-4] [05])?"))
    return out
