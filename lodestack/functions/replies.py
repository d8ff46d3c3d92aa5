"""Replies whose members are all texts and of known names, read as columns: a batch is parsed at once, and no entity or relation is a Python object.

Others (members that are no objects, numbers as names, keys that come twice, no JSON at all) are told apart, and left to model_output.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json as pj
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import ENTITY_TYPES, RELATION_TYPES
from .text import entity_forms

BLANKS = b" \t\n\r\x0b\x0c"
ENTITY = ("id", "type", "name", "description")
RELATION = ("source_id", "from_id", "target_id", "to_id", "type", "description")
KIND = (
    "struct<entities:array<struct<local_id:string,entity_type:string,name:string,normalized_name:string,description:string>>,"
    "relations:array<struct<source_id:string,target_id:string,relation_type:string,description:string,confidence:double>>>"
)
#: Bytes of replies in an Arrow batch, and of those that are parsed at once.
BATCH, BYTES = 8 << 20, 4 << 20
#: Numbers that a cast and float() read alike.
NUMBER = re.compile(r"\d{1,40}(\.\d{1,40})?([eE][+-]?\d{1,9})?")


class Other(ValueError):
    """A reply that needs to be read member by member."""


def _body(raw: bytes | None) -> bytes | None:
    """The text of an object, with or without a code fence around it."""
    text = (raw or b"").strip(BLANKS)
    if text.startswith(b"```") and text.endswith(b"```") and len(text) >= 6:
        text = text[3:-3]
        text = (text[4:] if text[:4].lower() == b"json" else text).strip(BLANKS)
    if not text.startswith(b"{"):
        return None
    if not text.isascii():
        try:
            text.decode()
        except UnicodeDecodeError:
            return None
    return text


def _schema(confidence: pa.DataType) -> pa.Schema:
    texts = lambda names: [pa.field(n, pa.string()) for n in names]
    kinds = {"entities": pa.list_(pa.struct(texts(ENTITY))), "relations": pa.list_(pa.struct([*texts(RELATION), pa.field("confidence", confidence)]))}
    return pa.schema([pa.field("r", pa.struct([pa.field(k, v) for k, v in kinds.items()]))])


def _told(lists: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The place of the reply of each member of the lists, and the members' columns."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), dict(zip(names, lists.flatten().flatten()))


def _text(*values: pa.Array) -> pa.Array:
    """The first that is not blank, trimmed."""
    trimmed = [pc.fill_null(pc.ascii_trim(v, BLANKS.decode()), "") for v in values]
    return trimmed[0] if len(trimmed) == 1 else pc.if_else(pc.equal(trimmed[0], ""), trimmed[1], trimmed[0])


def _looked_up(values: pa.Array, look: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """look() of each value, called once for each distinct one."""
    held = values.dictionary_encode()
    return pa.array([look(x) for x in held.dictionary.to_pylist()], kind).take(held.indices)


def _types(values: pa.Array, types: tuple[str, ...]) -> np.ndarray:
    """The place of each type among the known ones, -1 for others."""
    places = {t.lower(): i for i, t in enumerate(types)}
    return _looked_up(values, lambda x: places.get(x.lower(), -1), pa.int64()).to_numpy(zero_copy_only=False)


def _number(text: str) -> float:
    if not NUMBER.fullmatch(text):
        raise Other
    return min(1.0, float(text))


def _confidence(values: pa.Array) -> pa.Array:
    if pa.types.is_string(values.type):
        return _looked_up(pc.fill_null(values, "1"), _number, pa.float64())
    numbers = pc.fill_null(values, 1.0).to_numpy(zero_copy_only=False)
    if not np.isfinite(numbers).all():
        raise Other
    return pa.array(np.clip(numbers, 0.0, 1.0) + 0.0)


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the places of the first of each, in order."""
    distinct, at = np.unique(keys, return_index=True)
    return distinct, np.sort(at)


def _lists(owner: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _parsed(texts: list[bytes], confidence: pa.DataType) -> pa.StructArray:
    """Each text stands in an object of its own, so none can end another's: as many objects as texts are one for each."""
    buffer = b"\n".join(b'{"r":' + t + b"}" for t in texts)
    options = pj.ParseOptions(explicit_schema=_schema(confidence), newlines_in_values=True, unexpected_field_behavior="error")
    try:
        table = pj.read_json(pa.BufferReader(buffer), pj.ReadOptions(use_threads=False, block_size=len(buffer) + 1), options)
    except pa.ArrowInvalid as e:
        raise Other from e
    if table.num_rows != len(texts):
        raise Other
    return table.column("r").combine_chunks()


def _checked(parsed: pa.StructArray) -> pa.Array:
    """True for each reply, if _read can read them."""
    _confidence(_told(parsed.field("relations"), (*RELATION, "confidence"))[1]["confidence"])
    return pa.array(np.ones(len(parsed), bool))


def _read(parsed: pa.StructArray) -> pa.StructArray:
    """The entities and relations of objects, by the rules of model_output.extracted."""
    n = len(parsed)
    of, e = _told(parsed.field("entities"), ENTITY)
    ids, names, kinds = _text(e["id"]), _text(e["name"]), _types(_text(e["type"]), ENTITY_TYPES)
    kept = np.flatnonzero(pc.and_(pc.not_equal(ids, ""), pc.not_equal(names, "")).to_numpy(zero_copy_only=False) & (kinds >= 0))
    coded = ids.take(kept).dictionary_encode()
    known = max(1, len(coded.dictionary))
    keys, first = _firsts(of[kept] * known + coded.indices.to_numpy(zero_copy_only=False))
    kept = kept[first]
    said = names.take(kept)
    words = said.dictionary_encode()
    forms = entity_forms(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)).flatten().take(words.indices)
    entities = _lists(of[kept], n, {"local_id": ids.take(kept), "entity_type": pa.array(ENTITY_TYPES).take(kinds[kept]), "name": said, "normalized_name": forms, "description": _text(e["description"]).take(kept)})

    of, r = _told(parsed.field("relations"), (*RELATION, "confidence"))
    ends, kinds = (_text(r["source_id"], r["from_id"]), _text(r["target_id"], r["to_id"])), _types(_text(r["type"]), RELATION_TYPES)
    sure = _confidence(r["confidence"])
    places, there = [], kinds >= 0
    for end in ends:
        code = pc.fill_null(pc.index_in(end, coded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = of * known + code
        place = np.searchsorted(keys, key)
        there &= (code >= 0) & (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == key if len(keys) else False)
        places.append(place)
    kept = np.flatnonzero(there)
    _, first = _firsts((places[0][kept] * max(1, len(keys)) + places[1][kept]) * len(RELATION_TYPES) + kinds[kept])
    kept = kept[first]
    relations = _lists(of[kept], n, {"source_id": ends[0].take(kept), "target_id": ends[1].take(kept), "relation_type": pa.array(RELATION_TYPES).take(kinds[kept]), "description": _text(r["description"]).take(kept), "confidence": sure.take(kept)})
    return pa.StructArray.from_arrays([entities, relations], ["entities", "relations"])


def _part(texts: list[bytes | None], read: Callable[[pa.StructArray], pa.Array], kind: pa.DataType) -> list[pa.Array]:
    """The replies of a part read together, or in halves where one is unlike the others; null for what is no plain reply."""
    there = [t for t in texts if t is not None]
    for confidence in (pa.string(), pa.float64()) if there else ():  # it may be told as a text or as a number
        try:
            got = read(_parsed(there, confidence))
        except Other:
            continue
        at = np.cumsum([t is not None for t in texts]) - 1
        return [(got if len(there) == len(texts) else got.take(pa.array(at, mask=np.array([t is None for t in texts])))).cast(kind)]
    if len(there) < 2:
        return [pa.nulls(len(texts), kind)]
    half = len(texts) // 2
    return [*_part(texts[:half], read, kind), *_part(texts[half:], read, kind)]


def _parts(raws: pa.Array, read: Callable[[pa.StructArray], pa.Array], kind: pa.DataType) -> pa.Array:
    out, part, held = [pa.array([], kind)], [], 0
    for raw in raws:
        part.append(_body(raw.as_buffer().to_pybytes() if raw.is_valid else None))
        held += len(part[-1] or b"")
        if held >= BYTES:
            out += _part(part, read, kind)
            part, held = [], 0
    return pa.concat_arrays([*out, *(_part(part, read, kind) if part else [])])


def _arrow_type() -> pa.DataType:
    texts = lambda *names: [pa.field(n, pa.string()) for n in names]
    entity = pa.struct(texts("local_id", "entity_type", "name", "normalized_name", "description"))
    relation = pa.struct([*texts("source_id", "target_id", "relation_type", "description"), pa.field("confidence", pa.float64())])
    return pa.struct([pa.field("entities", pa.list_(entity)), pa.field("relations", pa.list_(relation))])


TYPE = _arrow_type()


def small_batches(replies: DataFrame) -> DataFrame:
    """replies, with Arrow batches of at most about BATCH bytes from now on in its session: Spark reads this when a plan runs, so it cannot be set for one alone. It
    is lowered, never raised: a batch stands in memory several times, on both sides of the pipe."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", replies.sparkSession.conf
    told = conf.get(key).rstrip("b")
    if told.isdigit() and int(told) > BATCH:
        conf.set(key, BATCH)
    return replies


def _flags(raws: pa.Array) -> pa.Array:
    """"1" or "0" for each reply, and a filler of a hundredth of its length. A worker's output waits until 64 KB of it have come together: without
    the filler, that would be some hundred batches, whose rows Spark holds for so long, in memory or on disk."""
    flag = pc.if_else(pc.fill_null(_parts(raws, _checked, pa.bool_()), False), "1", "0")
    return pc.binary_join_element_wise(flag, pc.binary_repeat("0", pc.divide(pc.fill_null(pc.binary_length(raws), 0), 100)), "")


def is_plain(raw: Column) -> Column:
    """Whether plain() reads a reply. Both parse it, so what the JVM makes of other replies need not be held beside what plain() tells."""

    @F.arrow_udf("string")
    def batch(values: pa.Array) -> pa.Array:
        return _flags(values)

    # Else the optimizer puts all that is read of other replies into each of its readers, to be computed anew there.
    return F.startswith(batch.asNondeterministic()(raw), F.lit("1"))


def plain(raw: Column) -> Column:
    """The entities and relations of each plain reply, null for others."""

    @F.arrow_udf(KIND)
    def batch(values: pa.Array) -> pa.Array:
        return _parts(values, _read, TYPE)

    return batch(raw)
