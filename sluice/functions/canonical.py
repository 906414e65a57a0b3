"""Canonical forms of a text that two texts are compared in, computed once per text.

Only Unicode folding and strict percent decoding need Python (one Arrow-batched function); all rules are expressions.
"""

from __future__ import annotations

import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MOST_CHARS = 16_384
SHINGLE = 5
EXACT_DOMAIN, RAW_DOMAIN = "similarity-profile-v2:primary-exact\0", "similarity-profile-v2:raw-exact\0"
NEGATIONS = (
    "deny denied denies disable disabled disallow except false forbid forbidden never no not reject rejected rejects"
    " revoke revoked revokes revoking unless without"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten".split()
SAME_TOKENS = {"sequence": "sequence", "sequences": "sequence"}
SECRET_LABELS = [["api", "key"], ["password"], ["access", "token"], ["client", "secret"]]
NUMBERED_LABELS = "invoice release status version".split()
SECURITY_VALUES = "credential password secret token".split()
SECURITY_WORDS = (
    "access account api auth authentication authorization bearer client credential credentials database field header"
    " identifier key metadata password policy private production public secret service token value"
).split()


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def fold(text: str) -> str:
    """Case folded, white space runs to one space, trimmed."""
    return " ".join(text.casefold().split())


def decoded(text: str) -> str | None:
    """Percent transport decoded once; None unless every % is a valid pair, the bytes are UTF-8 and nothing is a control
    character but tab and line ends. A plus sign stays."""
    text = text.strip()
    pairs = text.split("%")[1:]
    if not pairs or any(len(p) < 2 or not set(p[:2]) <= set("0123456789abcdefABCDEF") for p in pairs):
        return None
    try:
        out = unquote_to_bytes(text).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if any(unicodedata.category(c) == "Cc" and c not in "\t\r\n" for c in out) else out or None


def folded(x: Column) -> Column:
    """fold() of a string column."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(fold, na_action="ignore")

    return F.pandas_udf(run, "string")(x)


def stages(x: Column) -> Column:
    """struct(folded, nfkc, percent): the text folded, its compatibility form, and that of the decoded text where it is
    percent transport. Forms of texts over the bound are not needed and left empty."""

    def run(x: pd.Series) -> pd.DataFrame:
        x = x.fillna("")
        short = x.str.len() <= MOST_CHARS
        nfkc = [fold(unicodedata.normalize("NFKC", t)) if s else "" for t, s in zip(x, short)]
        plain = [decoded(t) if s and "%" in t else None for t, s in zip(x, short)]
        percent = [n if d is None else fold(unicodedata.normalize("NFKC", d)) for n, d in zip(nfkc, plain)]
        return pd.DataFrame({"folded": x.map(fold), "nfkc": nfkc, "percent": percent})

    return F.pandas_udf(run, "folded string, nfkc string, percent string")(x)


def tokens(x: Column) -> Column:
    """Maximal runs of letters and digits; null for a text over the bound."""
    return F.when(F.length(x) <= MOST_CHARS, F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}]+)"), 1))


def count_of(x: Column, kind: str) -> Column:
    return F.regexp_count(x, F.lit(kind))


def is_alpha(t: Column) -> Column:
    return t.rlike(r"^\p{L}+$")


def is_digits(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}+$")


def plain_number(t: Column) -> Column:
    """Digits that say little: up to three, or a year from 1900 to 2199."""
    return t.rlike(r"^(\p{Nd}{1,3}|(19|20|21)[0-9]{2})$")


def long_diverse(t: Column) -> Column:
    return is_alpha(t) & (F.length(t) >= 20) & (F.size(F.array_distinct(F.split(t, ""))) >= 10)


def mixed_token(t: Column) -> Column:
    """Some token of 8 or more characters with two letters and two digits at least."""
    return F.exists(t, lambda w: (F.length(w) >= 8) & (count_of(w, r"\p{L}") >= 2) & (count_of(w, r"\p{Nd}") >= 2))


def secret_shape(t: Column) -> Column:
    """A long diverse word alone or behind a label of secrets."""
    labelled = [(F.size(t) == len(label) + 1) & (F.slice(t, 1, len(label)) == words(label)) for label in SECRET_LABELS]
    behind = labelled[0]
    for other in labelled[1:]:
        behind = behind | other
    return ((F.size(t) == 1) | behind) & long_diverse(F.element_at(t, -1))


def separated_identifier(x: Column, t: Column) -> Column:
    """Letters and digits joined by marks, not all of whose numbers say little."""
    numbers = F.filter(t, is_digits)
    shape = x.rlike(r"^[\p{L}\p{N}\s._\-/]+$") & x.rlike(r"[._\-/]") & (count_of(x, r"\p{L}") >= 2) & (count_of(x, r"\p{Nd}") >= 4)
    return (F.size(t) >= 2) & shape & ((F.size(numbers) == 0) | F.exists(numbers, lambda w: ~plain_number(w)))


def numeric_secret(t: Column) -> Column:
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    label = joined.rlike(" (" + "|".join(" ".join(label) for label in SECRET_LABELS) + ") ")
    return F.exists(t, lambda w: is_digits(w) & (F.length(w) >= 8)) & label


def explicit_value(t: Column) -> Column:
    """A word for secrets, a digit, and a word of its own."""
    own = F.exists(t, lambda w: ~F.array_contains(words(SECURITY_WORDS), w) & ~is_digits(w))
    return F.arrays_overlap(t, words(SECURITY_VALUES)) & F.exists(t, lambda w: w.rlike(r"\p{Nd}")) & own


def distinctive(x: Column, t: Column) -> Column:
    found = secret_shape(t) | mixed_token(t) | separated_identifier(x, t) | numeric_secret(t) | explicit_value(t)
    return F.coalesce(found, F.lit(False))


def exact_only(t: Column) -> Column:
    """Texts of so little information that only an exact match counts: security words and small numbers, or a word with
    a number."""
    known = F.forall(t, lambda w: F.array_contains(words(SECURITY_WORDS), w) | plain_number(w))
    phrase = F.size(t).between(1, 6) & F.arrays_overlap(t, words(SECURITY_WORDS)) & known
    first, second = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    labelled = (F.size(t) == 2) & is_alpha(first) & is_digits(second) & (plain_number(second) | first.isin(NUMBERED_LABELS))
    return F.coalesce(phrase | labelled, F.lit(False))


def little_information(x: Column, t: Column) -> Column:
    """exact_only(), or one or two short words."""
    short = F.size(t).between(1, 2) & (F.length(x) < 16) & F.forall(t, is_alpha)
    return exact_only(t) | F.coalesce(short, F.lit(False))


def negated(t: Column) -> Column:
    return F.arrays_overlap(t, words(NEGATIONS))


def token_keys(t: Column) -> Column:
    """Tokens with number words and listed plurals replaced by one form."""
    same = {w: str(i) for i, w in enumerate(NUMBER_WORDS)} | SAME_TOKENS
    pairs = F.create_map(*(F.lit(x) for pair in same.items() for x in pair))
    return F.transform(t, lambda w: F.coalesce(F.try_element_at(pairs, w), w))


def identifier_key(x: Column) -> Column:
    """The text with separators of identifiers unified to /; the text itself where there is nothing to unify."""

    def of(t: Column) -> Column:
        joined = F.array_join(t, "/")
        shape = x.rlike(r"^[\p{L}\p{N}._\-/ ]+$") & x.rlike(r"[._\-/ ]") & (count_of(x, r"\p{Nd}") >= 4) & (count_of(x, r"\p{L}") >= 2)
        alone = shape & (F.size(t) >= 2) & (x.rlike(r"[._\-/]") | (F.size(t) >= 3)) & (joined != x)
        numbers = F.size(F.filter(t, lambda w: w.rlike(r"^\p{Nd}{4,}$") & ~plain_number(w)))
        within = mixed_token(t) | (numbers >= 2)
        return F.when(alone, joined).when(within, F.regexp_replace(x, r"[._\-/ ]+", "/")).otherwise(x)

    return F.coalesce(let(tokens(x), of), x)


def shingles(x: Column) -> Column:
    """Distinct 5-grams of code points; a shorter text is its own, an empty one has none. The text is split into characters
    once, so that the work is in proportion to its length."""

    def of(c: Column) -> Column:
        rest = lambda i: [F.get(c, i + k) for k in range(1, SHINGLE)]
        grams = F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - (SHINGLE - 1), F.lit(0))), lambda first, i: F.concat(first, *rest(i)))
        return F.when(F.size(c) <= SHINGLE, F.array(x)).otherwise(F.array_distinct(grams))

    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(let(F.split(x, ""), of))


def with_prepared(rows: DataFrame, text: str, name: str = "prepared") -> DataFrame:
    """rows with the column `name`: struct(text, normalized, bounded, exact_key, low, features, forms) of a text column.

    forms are four aligned stages (compatibility form, percent decoded, slashes of JSON, separators of identifiers), each
    with its tokens and what the comparison asks of them. A text over the bound has its raw text as exact key and no
    features; one of little information has no features.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    staged = rows.select(*kept, stages(F.col(text)).alias("_stages"))
    return staged.select(*kept, _prepared(F.coalesce(F.col(text), F.lit("")), F.col("_stages")).alias(name))


def _prepared(text: Column, s: Column) -> Column:
    normalized = s["folded"]

    def form(x: Column) -> Column:
        def of(t: Column) -> Column:
            parts = {
                "x": x, "t": t, "k": token_keys(t), "negated": negated(t), "distinctive": distinctive(x, t),
                "little": little_information(x, t), "exact_only": exact_only(t),
                "boundaries": F.coalesce(((F.length(x) >= 10) & x.rlike(r"\p{L}") & x.rlike(r"\p{Nd}")) | secret_shape(t), F.lit(False)),
            }
            return F.struct(*(v.alias(k) for k, v in parts.items()))

        return let(tokens(x), of)

    def whole(r: Column) -> Column:
        low = F.exists(r["forms"], lambda f: f["exact_only"])
        canonical = F.when(r["bounded"] & ~low, F.element_at(r["forms"], -1)["x"]).otherwise(normalized)
        keyed = F.when(r["bounded"], F.concat(F.lit(EXACT_DOMAIN), canonical)).otherwise(F.concat(F.lit(RAW_DOMAIN), text))
        features = F.when(r["bounded"] & ~low, shingles(canonical)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            text.alias("text"), normalized.alias("normalized"), r["bounded"].alias("bounded"), F.sha2(keyed, 256).alias("exact_key"),
            low.alias("low"), features.alias("features"), r["forms"].alias("forms"),
        )

    slashes = F.replace(s["percent"], F.lit("\\/"), F.lit("/"))
    key = F.when(exact_only(tokens(slashes)), slashes).otherwise(identifier_key(slashes))
    bounded = (F.length(text) <= MOST_CHARS) & (F.length(normalized) <= MOST_CHARS) & (F.length(s["nfkc"]) <= MOST_CHARS) & (F.length(s["percent"]) <= MOST_CHARS)
    xs = F.when(bounded, F.array(s["nfkc"], s["percent"], slashes, key)).otherwise(F.array(normalized))
    return let(F.struct(bounded.alias("bounded"), F.transform(xs, form).alias("forms")), whole)
