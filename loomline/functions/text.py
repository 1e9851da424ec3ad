"""Text and array functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contractions and their long forms.
CONTRACTIONS = {"can't": "can not", "won't": "will not", "n't": " not", "'re": " are", "'s": " is", "'d": " would", "'ll": " will", "'ve": " have", "'m": " am"}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]+", " "))), " +")


def expand_contractions(text: Column) -> Column:
    for short, long in CONTRACTIONS.items():
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def clean(text: Column, contractions: bool = True) -> Column:
    """Lower case, no tags, no URLs, contractions expanded, letters and digits only, single spaces."""
    text = F.regexp_replace(F.regexp_replace(F.lower(text), "<[^>]*>", " "), r"https?://\S+|www\.\S+", " ")
    text = expand_contractions(text) if contractions else text
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def letters_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda x: ~x.isin(stop))


def fixed_length(values: Column, n: int, fill: Column) -> Column:
    """The first n values, filled up on the right."""
    return F.slice(F.concat(values, F.array_repeat(fill, n)), 1, n)


def chunks(text: Column, n: int = 512) -> Column:
    """Consecutive pieces of n characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / n) - 1, F.lit(0)).cast("int")), lambda i: F.substr(text, i * n + 1, F.lit(n)))


def permission(octal: Column, directory: Column) -> Column:
    """Octal permission digits as a string like drwxr-xr-x."""
    bits = F.lpad(F.conv(octal, 8, 2), 9, "0")
    marks = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.when(F.substr(bits, i, F.lit(1)) == "1", F.element_at(F.array(F.lit("x"), F.lit("r"), F.lit("w")), (i % 3 + 1).cast("int"))).otherwise("-"))
    return F.concat(F.when(directory, "d").otherwise("-"), F.concat_ws("", marks))


def epoch_ms(ms: Column) -> Column:
    """MM/dd/year HH:mm; a year has four digits at least and no sign unless it is before 0."""
    at = F.timestamp_millis(ms)
    year = F.year(at).cast("string")
    return F.concat(F.date_format(at, "MM/dd/"), F.when(F.year(at).between(0, 999), F.lpad(year, 4, "0")).otherwise(year), F.date_format(at, " HH:mm"))


def ancestors(node: Column, parent: Callable[[Column], Column], most: int) -> Column:
    """Parent, its parent and so on up to the first that is not above 0, for parents that are a function of the node; no chain may take more than ``most`` steps."""
    def up(chain: Column, _: Column) -> Column:
        top = F.element_at(chain, -1)
        return F.when(top > 0, F.concat(chain, F.array(parent(top)))).otherwise(chain)

    return F.aggregate(F.sequence(F.lit(2), F.lit(most)), F.array(parent(node)), up)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def label_score(a: Column, b: Column) -> Column:
    """Jaccard of two label sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def trailing_zeros(h: Column) -> Column:
    """Of a hash; 0 for 0."""
    return F.when(h == 0, 0).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))


def by_prefix(df: DataFrame, baseline: list[str], prefixes: list[str]) -> DataFrame:
    """The baseline columns and those whose names begin with a prefix, in order."""
    return df.select(*baseline, *[c for c in df.columns if c not in baseline and c.startswith(tuple(prefixes))])


def parse_dict(text: Column, schema: str) -> Column:
    """A string that looks like a Python dict, as a struct; null if it doesn't."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.when(F.trim(text).startswith("{"), F.from_json(body, schema, {"allowSingleQuotes": "true"}))


def flatten(df: DataFrame) -> DataFrame:
    """Structs of any depth as columns, their keys joined by _."""
    def leaves(kind, path, name):
        if kind.typeName() != "struct":
            return [path.alias(name)]
        return [x for f in kind.fields for x in leaves(f.dataType, path.getField(f.name), f"{name}_{f.name}")]

    return df.select(*[x for f in df.schema.fields for x in leaves(f.dataType, F.col(f"`{f.name}`"), f.name)])
