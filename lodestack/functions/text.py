"""Text columns: white space, tokens, normal forms, truncation and redaction.

Normal forms that need Unicode tables which Spark lacks (case folding, NFKC, NFD) are Arrow-batched UDFs; everything else is
built in. White space is Unicode's, as in Python's str.split.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of white space but single spaces, which are what they become: most of a text is passed over without a match.
SPACES = "(?U)[\\s&&[^ ]]\\s*| \\s+"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def token_count(text: Column) -> Column:
    """White-space tokens, the fallback where no tokenizer is configured."""
    clean = collapse(text)
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit(""))) + 1)


def at_most_tokens(text: Column, n: int) -> Column:
    """token_count(text) <= n, read no further than to the next token."""
    return ~text.rlike(f"(?U)(?<!\\S)(?:\\S++\\s++){{{n}}}\\S")


def tokens(text: Column) -> Column:
    return bound(collapse(text), lambda clean: F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ")))


def normalize_for_dedupe(text: Column) -> Column:
    return F.lower(collapse(text))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_for_dedupe(text), 256)


def casefold_latin(text: Column) -> Column:
    """Case folding by built-ins: exact for Latin-1 text, where only the sharp s folds to more than its lower case."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: Values of a batch that are Python objects at a time.
HELD = 64


def mapped(column: Column, function: Callable[[str], object], kind: str = "string") -> Column:
    """function of every value that is not null, in Arrow batches, of which only a few values at a time are Python's.

    The UDF is made here, as workers can't make one.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    target = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def batch(values: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else function(x) for x in values.slice(at, HELD).to_pylist()], target) for at in range(0, len(values), HELD)]
        return pa.concat_arrays(parts) if parts else pa.array([], target)

    return batch(column)


def entity_form(name: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", name).casefold().split())


def entity_name(names: Column) -> Column:
    """Entity names at extraction: NFKC, case folding, single spaces."""
    return mapped(names, entity_form)


def entity_forms(names: pa.ListArray) -> pa.ListArray:
    """entity_form of every name in lists. Names in ASCII, which only need lower case and single spaces, stay Arrow's."""
    flat = names.flatten().cast(pa.string())
    forms = pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(flat), r"[\t-\r\x1c-\x20]+", " "), " ")
    others = pc.fill_null(pc.invert(pc.string_is_ascii(flat)), False)
    if pc.any(others).as_py():
        held = flat.filter(others)
        told = [pa.array(map(entity_form, held.slice(at, HELD).to_pylist()), pa.string()) for at in range(0, len(held), HELD)]
        forms = pc.replace_with_mask(forms, others, pa.concat_arrays(told))
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(names), 0)).cast(pa.int32())
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), forms, mask=names.is_null())


def entity_names(names: Column) -> Column:
    """entity_name of arrays of names."""

    @F.arrow_udf("array<string>")
    def batch(values: pa.Array) -> pa.Array:
        return entity_forms(values)

    return batch(names)


def query_name(names: Column) -> Column:
    """Entity names at query time: case folding and single spaces, without NFKC."""
    return mapped(names, lambda x: " ".join(x.casefold().split()))


_NOT_PLAIN, _OTHERS = re.compile("[^a-z0-9]+"), re.compile("[^\\x00-\\x7f]+")


def plain(text: str | None) -> str:
    """Case folded, marks dropped, everything but a-z and 0-9 a space. Letters that do not decompose separate words."""
    folded = unicodedata.normalize("NFD", (text or "").casefold())
    if not folded.isascii():
        folded = _OTHERS.sub(lambda x: "".join(c for c in x[0] if unicodedata.category(c) != "Mn"), folded)
    return _NOT_PLAIN.sub(" ", folded).strip()


def policy_text(texts: Column) -> Column:
    """plain() of each text; a null one is empty."""
    return mapped(F.coalesce(texts, F.lit("")), plain)


def contains_phrase(normal: Column, term: str) -> Column:
    """The whole words of term in a text that policy_text made."""
    return F.contains(F.concat(F.lit(" "), normal, F.lit(" ")), F.lit(f" {plain(term)} ")) if plain(term) else F.lit(False)


def truncate(text: Column, limit: int, ellipsis_only: bool = False) -> Column:
    """At most limit characters of the collapsed text, with "..." where it was cut; ellipsis_only: also under four."""
    clean = collapse(F.coalesce(text, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(clean, 1, max(0, limit - 3))), F.lit("..."))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut if limit > 3 or ellipsis_only else F.substring(clean, 1, limit))


#: Fixed patterns of secrets: named keys, and two providers' key formats.
NAMED_SECRET = "(?i)(api[_-]?key|authorization|bearer|x-goog-api-key)(\\s*[=:]\\s*)\\S+"
GATEWAY_KEY, EMBEDDING_KEY = "(?i)sk-[a-z0-9_-]{8,}", "(?i)(AIza)[a-z0-9_-]{12,}"


def redact(text: Column, embedding: bool = False) -> Column:
    named = F.regexp_replace(F.coalesce(text, F.lit("")), NAMED_SECRET, "$1$2[redacted]")
    return F.regexp_replace(named, EMBEDDING_KEY, "$1[redacted]") if embedding else F.regexp_replace(named, GATEWAY_KEY, "[redacted]")


def mask_secret(secret: Column) -> Column:
    """First and last four characters; of secrets of up to eight the last two; none of none."""
    return F.when(F.coalesce(secret, F.lit("")) == "", F.lit("")).when(F.length(secret) <= 8, F.concat(F.lit("..."), F.right(secret, F.lit(2)))).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4))))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def safe_name(name: Column, default: str = "document") -> Column:
    """Other characters than letters, digits, `_`, `.` and `-` become `_`; dots and `_` at the ends go."""
    clean = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9_.-]+", "_"), F.lit("._"))
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def iso_timestamp(stamp: Column) -> Column:
    """An ISO 8601 time; Z and offsets are read, a time without one is of the session's zone, anything else is null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(stamp), "[zZ]$", "+00:00"))
