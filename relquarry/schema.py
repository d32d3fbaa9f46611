"""Index schema and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

#: Field types and the Spark types that hold them; unsigned ones are widened.
TYPES: dict[str, T.DataType] = {
    "U8": T.ShortType(), "U16": T.IntegerType(), "U32": T.LongType(), "U64": T.DecimalType(20, 0),
    "I8": T.ByteType(), "I16": T.ShortType(), "I32": T.IntegerType(), "I64": T.LongType(),
    "Timestamp": T.LongType(), "F32": T.FloatType(), "F64": T.DoubleType(), "Bool": T.BooleanType(),
    "String16": T.StringType(), "String32": T.StringType(),
    "StringSet16": T.ArrayType(T.StringType()), "StringSet32": T.ArrayType(T.StringType()),
    "Point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "Text": T.StringType(), "Json": T.StringType(), "Binary": T.StringType(),
}
NUMERIC = {"U8", "U16", "U32", "U64", "I8", "I16", "I32", "I64", "Timestamp", "F32", "F64"}
SIMILARITIES, TOKENIZERS = ("Bm25f", "Bm25fProximity"), ("AsciiAlphabetic", "UnicodeAlphanumeric", "UnicodeAlphanumericFolded", "Whitespace", "WhitespaceLowercase", "UnicodeAlphanumericZH")
QUANTIZATIONS = ("None", "I8", "RotatedI8")
#: Kinds of n-grams that an index may hold (F: frequent word, R: rare word).
NGRAMS = {"FF": 1, "FR": 2, "RF": 4, "FFF": 8, "RFF": 16, "FFR": 32, "FRF": 64}


@dataclass(frozen=True)
class SchemaField:
    field: str
    store: bool = True
    index_lexical: bool = False
    index_vector: bool = False
    field_type: str = "Text"
    facet: bool = False
    longest: bool = False
    boost: float = 1.0
    dictionary_source: bool = False
    completion_source: bool = False

    def __post_init__(self):
        if self.field_type not in TYPES:
            raise ValueError(f"{self.field}: unknown type {self.field_type}")
        if self.field_type == "Binary" and self.index_lexical:
            object.__setattr__(self, "index_lexical", False)

    @property
    def spark_type(self) -> T.DataType:
        return TYPES[self.field_type]


@dataclass(frozen=True)
class SpellingCorrection:
    max_dictionary_edit_distance: int = 1
    term_length_threshold: tuple[int, ...] | None = (2, 8)
    count_threshold: int = 20
    max_dictionary_entries: int = 500_000


@dataclass(frozen=True)
class QueryCompletion:
    max_completion_entries: int = 10_000_000


@dataclass(frozen=True)
class IndexMeta:
    name: str = "index"
    lexical_similarity: str = "Bm25fProximity"
    tokenizer: str = "UnicodeAlphanumeric"
    stemmer: str | None = None
    stop_words: tuple[str, ...] = ()
    frequent_words: tuple[str, ...] | str = "english"
    ngram_indexing: int = NGRAMS["FF"] | NGRAMS["FFF"]
    document_compression: str = "snappy"
    spelling_correction: SpellingCorrection | None = None
    query_completion: QueryCompletion | None = None
    vector_similarity: str = "Dot"
    quantization: str = "None"
    clustering: str | int = "Auto"
    chunk_size: int = 1000
    #: Word segmentation of UnicodeAlphanumericZH: (word, frequency).
    zh_dictionary: tuple[tuple[str, float], ...] = ()
    #: Documents after which a level is committed by itself, and levels that are merged into one; 0: never.
    auto_commit_docs: int = 0
    merge_levels: int = 0

    def __post_init__(self):
        if self.quantization not in QUANTIZATIONS:
            raise ValueError(f"unknown quantization {self.quantization}")
        if self.lexical_similarity not in SIMILARITIES:
            raise ValueError(f"unknown similarity {self.lexical_similarity}")
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {self.tokenizer}")


@dataclass(frozen=True)
class Schema:
    fields: tuple[SchemaField, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [f.field for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("field names repeat")
        if sum(f.longest for f in self.fields) > 1:
            raise ValueError("only one field can be the longest")
        object.__setattr__(self, "fields", tuple(self.fields))

    def __getitem__(self, name: str) -> SchemaField:
        return next(f for f in self.fields if f.field == name)

    def __contains__(self, name: str) -> bool:
        return any(f.field == name for f in self.fields)

    @property
    def lexical(self) -> list[SchemaField]:
        return [f for f in self.fields if f.index_lexical]

    @property
    def facets(self) -> list[SchemaField]:
        return [f for f in self.fields if f.facet]

    @property
    def vectors(self) -> list[SchemaField]:
        return [f for f in self.fields if f.index_vector]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.field, f.spark_type, True) for f in self.fields])

    def to_json(self) -> str:
        return json.dumps([asdict(f) for f in self.fields])

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls(tuple(SchemaField(**f) for f in json.loads(text)))


def meta_to_json(meta: IndexMeta) -> str:
    return json.dumps(asdict(meta))


def meta_from_json(text: str) -> IndexMeta:
    d = json.loads(text)
    for k in ("stop_words", "frequent_words"):
        d[k] = tuple(d[k]) if isinstance(d[k], list) else d[k]
    d["zh_dictionary"] = tuple(map(tuple, d.get("zh_dictionary") or ()))
    s = d.get("spelling_correction")
    d["spelling_correction"] = s and SpellingCorrection(**(s | {"term_length_threshold": s["term_length_threshold"] and tuple(s["term_length_threshold"])}))
    c = d.get("query_completion")
    d["query_completion"] = c and QueryCompletion(**c)
    return replace(IndexMeta(), **d)
