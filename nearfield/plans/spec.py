"""Table specifications, and the parser of their one-line definitions.

``name type`` items separated by commas: vector columns (``v float[64] distance_metric=cosine indexed by
ivf(nlist=128)``), ``p text partition key``, ``id integer primary key``, ``+aux blob``, metadata columns
(``n integer``), and the option ``chunk_size=N``.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from nearfield.errors import VectorError

DIMS_MAX, VECTORS_MAX, PARTITIONS_MAX, AUX_MAX, METADATA_MAX, CHUNK_MAX = 8192, 16, 4, 16, 16, 4096
# The type words of the definition language.
VECTOR_WORDS = {"float": "float32", "f32": "float32", "int8": "int8", "i8": "int8", "bit": "bit"}
SCALAR_WORDS = {"integer": "bigint", "int": "bigint", "boolean": "boolean", "bool": "boolean", "float": "double", "double": "double", "text": "string", "blob": "binary"}
INDEX_OPTIONS = {
    "flat": {},
    "rescore": {"quantizer": ("bit", "int8"), "oversample": (1, 128)},
    "ivf": {"nlist": (0, 65536), "nprobe": (1, 65536), "quantizer": ("none", "int8", "binary"), "oversample": (1, 4096)},
    "diskann": {"neighbor_quantizer": ("binary", "int8"), "n_neighbors": (8, 256), "search_list_size": (1, 65536), "search_list_size_search": (1, 65536), "search_list_size_insert": (1, 65536), "buffer_threshold": (0, 1 << 31)},
}
INDEX_DEFAULTS = {"flat": {}, "rescore": {"oversample": 8}, "ivf": {"nlist": 128, "nprobe": 10, "quantizer": "none", "oversample": 1}, "diskann": {"n_neighbors": 72, "search_list_size": 128, "buffer_threshold": 0}}


@dataclass
class VectorColumn:
    name: str
    elem: str
    dims: int
    metric: str = "l2"
    index: str = "flat"
    options: dict = field(default_factory=dict)

    def spark_type(self) -> T.DataType:
        return T.BinaryType() if self.elem == "bit" else T.ArrayType(T.FloatType() if self.elem == "float32" else T.ByteType())


@dataclass
class VecTableSpec:
    vectors: list[VectorColumn]
    key: str = "rowid"
    key_type: str = "bigint"
    partitions: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    auxiliary: dict[str, str] = field(default_factory=dict)
    chunk_size: int = 1024
    strict_compat: bool = False

    @classmethod
    def parse(cls, text: str, strict_compat: bool = False) -> VecTableSpec:
        """The specification that a definition states; VectorError names the item that fits nothing."""
        spec, has_key = cls([], strict_compat=strict_compat), False
        for item in _items(text):
            if m := re.fullmatch(r"(?is)(\w+)\s+(\w+?)\s*\[\s*(\d+)\s*\]\s*(.*)", item):
                spec.vectors.append(_vector(*m.groups()))
            elif m := re.fullmatch(r"(?i)(\w+)\s+(integer|int|text)\s+partition\s+key", item):
                spec.partitions[m[1]] = SCALAR_WORDS[m[2].lower()]
            elif m := re.fullmatch(r"(?i)(\w+)\s+(integer|int|text)\s+primary\s+key", item):
                if has_key:
                    raise VectorError("more than one primary key definition was provided")
                spec.key, spec.key_type, has_key = m[1], SCALAR_WORDS[m[2].lower()], True
            elif (m := re.fullmatch(r"\+\s*(\w+)\s+(\w+)", item)) and _word(m[2], ("text", "integer", "int", "float", "double", "blob")):
                spec.auxiliary[m[1]] = SCALAR_WORDS[_word(m[2], ("text", "integer", "int", "float", "double", "blob"))]
            elif m := re.fullmatch(r"(?i)chunk_size\s*=\s*(\d+)", item):
                spec.chunk_size = int(m[1])
                if spec.chunk_size % 8 or not 8 <= spec.chunk_size <= CHUNK_MAX:
                    raise VectorError("chunk_size must be divisible by 8, above 0 and at most 4096")
            elif (m := re.fullmatch(r"(\w+)\s+(\w+)", item)) and (w := _word(m[2], ("boolean", "bool", "integer", "int", "float", "double", "text"))):
                spec.metadata[m[1]] = SCALAR_WORDS[w]
            else:
                raise VectorError(f"Could not parse '{item}'")
        spec.check()
        return spec

    def check(self) -> None:
        if not self.vectors:
            raise VectorError("At least one vector column is required")
        for what, n, most in (("vector", self.vectors, VECTORS_MAX), ("partition key", self.partitions, PARTITIONS_MAX), ("auxiliary", self.auxiliary, AUX_MAX), ("metadata", self.metadata, METADATA_MAX)):
            if len(n) > most:
                raise VectorError(f"Too many {what} columns were provided; at most {most}")
        names = [self.key, *(v.name for v in self.vectors), *self.partitions, *self.metadata, *self.auxiliary]
        if len({n.lower() for n in names}) < len(names):
            raise VectorError("duplicate column name")
        for v in self.vectors:
            if self.strict_compat and v.index != "flat" and (self.metadata or self.partitions):
                raise VectorError(f"{v.index} indexes do not allow metadata or partition key columns")
            if v.index == "rescore" and v.elem != "float32":
                raise VectorError("rescore needs a float32 column")
            if v.index == "diskann" and v.elem == "bit":
                raise VectorError("diskann does not take bit columns")
            if v.dims % 8 and (v.options.get("quantizer") in ("bit", "binary") or v.options.get("neighbor_quantizer") == "binary"):
                raise VectorError("binary quantizers need dimensions divisible by 8")

    def schema(self) -> T.StructType:
        scalar = lambda name, kind, null=True: T.StructField(name, T._parse_datatype_string(kind), null)
        return T.StructType([scalar(self.key, self.key_type, False), *(T.StructField(v.name, v.spark_type(), False, {"vector": json.dumps({"elem": v.elem, "dims": v.dims, "metric": v.metric, "index": v.index})}) for v in self.vectors), *(scalar(n, k) for n, k in (self.metadata | self.auxiliary | self.partitions).items())])

    def vector(self, name: str | None = None) -> VectorColumn:
        for v in self.vectors:
            if name is None or v.name == name:
                return v
        raise VectorError(f"no vector column {name}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> VecTableSpec:
        held = json.loads(text)
        return cls(**held | {"vectors": [VectorColumn(**v) for v in held["vectors"]]})


def _items(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [x for x in [*out, now.strip()] if x]


def _word(given: str, words: tuple[str, ...]) -> str | None:
    """The type word that given is, or is the beginning of."""
    return next((w for w in words if w.startswith(given.lower())), None)


def _vector(name: str, kind: str, dims: str, rest: str) -> VectorColumn:
    word = next((w for w in VECTOR_WORDS if kind.lower().startswith(w)), None)
    if word is None:
        raise VectorError(f"Could not parse '{name} {kind}[{dims}]'")
    v = VectorColumn(name, VECTOR_WORDS[word], int(dims))
    if not 0 < v.dims <= DIMS_MAX:
        raise VectorError(f"Dimension on vector column must be between 1 and {DIMS_MAX}, found {dims}")
    if v.elem == "bit":
        v.metric = "hamming"
        if v.dims % 8:
            raise VectorError("bit vectors need dimensions divisible by 8")
    if m := re.match(r"(?i)distance_metric\s*=\s*(\w+)\s*", rest):
        if v.elem == "bit" or m[1].lower() not in ("l2", "l1", "cosine"):
            raise VectorError(f"distance_metric {m[1]} is not allowed on column {name}")
        v.metric, rest = m[1].lower(), rest[m.end() :]
    if m := re.fullmatch(r"(?is)indexed\s+by\s+(\w+)\s*\((.*)\)\s*", rest):
        v.index = m[1].lower()
        if v.index not in INDEX_OPTIONS:
            raise VectorError(f"unknown index type {m[1]}")
        v.options = dict(INDEX_DEFAULTS[v.index])
        for item in filter(None, map(str.strip, m[2].split(","))):
            key, eq, value = (x.strip().lower() for x in item.partition("="))
            allowed = INDEX_OPTIONS[v.index].get(key)
            if not eq or allowed is None:
                raise VectorError(f"unknown {v.index} option '{item}'")
            if isinstance(allowed[0], str):
                if value not in allowed:
                    raise VectorError(f"{key} must be one of {', '.join(allowed)}")
                v.options[key] = value
            else:
                if not value.isdigit() or not allowed[0] <= int(value) <= allowed[1]:
                    raise VectorError(f"{key} must be between {allowed[0]} and {allowed[1]}")
                v.options[key] = int(value)
        _index_rules(v, m[2])
    elif rest:
        raise VectorError(f"Could not parse '{rest}'")
    return v


def _index_rules(v: VectorColumn, given: str) -> None:
    o = v.options
    if v.index == "rescore" and "quantizer" not in o:
        raise VectorError("rescore requires a quantizer")
    if v.index == "diskann" and ("neighbor_quantizer" not in o or o["n_neighbors"] % 8):
        raise VectorError("diskann requires a neighbor_quantizer, and n_neighbors divisible by 8")
    if v.index == "ivf":
        if "nprobe" in given.lower() and o["nlist"] and o["nprobe"] > o["nlist"]:
            raise VectorError("nprobe must not be above nlist")
        if o["oversample"] > 1 and o["quantizer"] == "none":
            raise VectorError("oversample above 1 requires a quantizer")
