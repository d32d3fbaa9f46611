"""Documents to relations: postings, statistics, dictionaries, completions.

Python workers take documents in blocks of a bounded number of tokens. A block is inverted
by one sort of its tokens, and its postings are written as files of their own, a file a
bucket, so that no posting is shuffled: only the block's distinct terms are, with their
document frequencies.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions.words import word_list
from ..plans.query import ngram_kinds
from ..schema import IndexMeta, Schema
from ..storage import prepare

#: Tokens of a block of postings, and of one of completions; bytes of text that are split at once.
BLOCK, GRAM_BLOCK, SLICE = 2_000_000, 1_000_000, 8 << 20
#: Tokens of the texts whose completions one task adds up.
GRAM_PART = 1_000_000
#: Texts with characters of over one byte in Latin-1 are split by the tokenizer's expression, others by their bytes. (One range: the expression is tried at every character.)
_BEYOND = r"[\x{100}-\x{10ffff}]"
_WORD = {"L", "M", "Nd", "Pc"}


def _kind(c: int) -> int:
    """1: part of a word; 2: part of a word but not its start; 0: neither."""
    cat = unicodedata.category(chr(c))
    return 1 if cat[0] in _WORD or cat in _WORD else 2 if chr(c) in "+#-" else 0


_ONE = np.array([_kind(c) if c < 128 else 0 for c in range(256)], np.uint8)
_TWO = np.array([_kind(c) for c in range(0x100)], np.uint8)
_LOWER = np.array([c + 32 * (65 <= c <= 90) for c in range(256)], np.uint8)
_LOWER_C3 = np.array([c + 32 * (0x80 <= c <= 0x9E and c != 0x97) for c in range(256)], np.uint8)  # the second byte of a letter of Latin-1


def field_rows(docs: DataFrame, schema: Schema, meta: IndexMeta, only: list[int] | None = None) -> DataFrame:
    """doc_id, and for each lexical field x: its text, if words can be cut from its bytes; t: else its tokens."""
    prepare(docs.sparkSession)
    text = lambda f: analysis.json_text(F.col(f"`{f.field}`")) if f.field_type == "Json" else F.array_join(F.col(f"`{f.field}`"), " ") if f.field_type.startswith("StringSet") else F.col(f"`{f.field}`").cast("string")
    plain = meta.tokenizer == "UnicodeAlphanumeric" and not word_list(meta.stop_words) and (meta.stemmer or "none").lower() == "none"
    columns = []
    for i, f in enumerate(schema.lexical):
        if only is None or i in only:
            c = text(f)
            by_bytes = ((F.octet_length(c) == F.length(c)) | ~c.rlike(_BEYOND)) if plain else F.lit(False)
            columns += [F.when(by_bytes, c).alias(f"x{i}"), F.when(~by_bytes, analysis.analyze(c, meta)).alias(f"t{i}")]
    return docs.select("doc_id", *columns)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case tokens of texts in Latin-1, and the number of each text's."""
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or at[-1] == at[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind, two = _ONE[data], np.flatnonzero((data == 0xC2) | (data == 0xC3))
    data = _LOWER[data]
    if len(two):
        of = _TWO[(data[two] & 3) << 6 | data[two + 1] & 63]
        kind[two], kind[two + 1] = of, of
        capital = two[data[two] == 0xC3] + 1
        data[capital] = _LOWER_C3[data[capital]]
    word, firsts = kind != 0, at[:-1][at[:-1] < len(data)]
    edge = np.empty(len(data) + 1, bool)  # whether a run may not go on from one byte to the next
    edge[0] = edge[-1] = True
    edge[1:-1] = ~(word[:-1] & word[1:])
    edge[firsts] = True
    start, end = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:]) + 1
    signs = np.flatnonzero(kind[start] == 2)
    if len(signs):  # a word begins at the first letter of the run
        letters = np.append(np.flatnonzero(kind == 1), len(data))
        start[signs] = letters[np.searchsorted(letters, start[signs])]
        keep = start < end
        start, end = start[keep], end[keep]
    step = np.zeros(len(data) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    values = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(values)), np.diff(np.searchsorted(start, at))


@dataclass
class Block:
    """Tokens of whole documents. By row, which is a document's field: doc_id, number of the document, field, number of tokens."""

    words: pa.Array
    ids: pa.Array
    doc: np.ndarray
    field: np.ndarray
    count: np.ndarray


def blocks(batches, fields: list[int], most: int) -> Iterator[Block]:
    rows, held, docs = [], 0, 0
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns[1:]:
            size += (pc.binary_length(c) if not pa.types.is_list(c.type) else pc.multiply(pc.list_value_length(c), 8)).fill_null(0).to_numpy(zero_copy_only=False)
        part, at = np.cumsum(size) // SLICE, 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(part, part[at], "right")))
            piece = b.slice(at, end - at)
            for i, f in enumerate(fields):
                listed = piece.column(2 * i + 2)
                for words, n in (cut(piece.column(2 * i + 1)), (listed.flatten(), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))):
                    if len(words):
                        own = np.flatnonzero(n)
                        rows.append((words.cast(pa.string()), piece.column(0).take(pa.array(own)), own + docs, np.full(len(own), f), n[own].astype(np.int64)))
                        held += len(words)
            docs += end - at
            at = end
            if held >= most:
                yield Block(pa.concat_arrays([r[0] for r in rows]), pa.concat_arrays([r[1] for r in rows]), *(np.concatenate([r[k] for r in rows]) for k in (2, 3, 4)))
                rows, held, docs = [], 0, 0
    if rows:
        yield Block(pa.concat_arrays([r[0] for r in rows]), pa.concat_arrays([r[1] for r in rows]), *(np.concatenate([r[k] for r in rows]) for k in (2, 3, 4)))


def _quantized(n: np.ndarray) -> np.ndarray:
    """analysis.quantized_length."""
    rest = np.maximum(n - 24, 1)
    shift = np.maximum(np.frexp(rest.astype(np.float64))[1].astype(np.int64) - 4, 0)
    return np.where(n < 32, n, 24 + (rest >> shift << shift))


def _pairs(a: np.ndarray, b: np.ndarray, v: int, **more):
    """Distinct pairs of numbers under v, in order, with what else np.unique gives."""
    bits = max(1, v.bit_length())
    key, *rest = np.unique(a << bits | b, **more)
    return (key >> bits, key & (1 << bits) - 1), *rest


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, v: int, **more):
    bits = max(1, v.bit_length())
    if 3 * bits > 63:
        (first, second), pair = _pairs(a, b, v, return_inverse=True)
        key, *rest = np.unique(pair << bits | c, **more)
        return (first[key >> bits], second[key >> bits], key & (1 << bits) - 1), *rest
    key, *rest = np.unique(a << 2 * bits | b << bits | c, **more)
    return (key >> 2 * bits, key >> bits & (1 << bits) - 1, key & (1 << bits) - 1), *rest


def _joined(words: pa.Array, *numbers: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(k)) for k in numbers], " ") if len(numbers) > 1 else words.take(pa.array(numbers[0]))


def _with_ngrams(words: pa.Array, code, row, place, frequent: list[str], mask: int):
    """Overlapping n-grams of the kinds of the mask, as further terms at their first word's place."""
    often = pc.is_in(words, pa.array(frequent, pa.string())).to_numpy(zero_copy_only=False)[code]
    v, terms, codes, ats = len(words), [words], [code], [np.arange(len(code))]
    for n in (2, 3):
        kinds = [k for k in ngram_kinds(mask) if len(k) == n]
        size = max(0, len(code) - n + 1)
        last = slice(n - 1, n - 1 + size)
        found = np.zeros(size, bool)
        for k in kinds:
            found |= np.logical_and.reduce([often[j : j + size] == (x == "F") for j, x in enumerate(k)])
        at = np.flatnonzero(found & (row[:size] == row[last]))
        if len(at):
            if n == 2:
                numbers, inverse = _pairs(code[at], code[at + 1], v, return_inverse=True)
            else:
                numbers, inverse = _triples(code[at], code[at + 1], code[at + 2], v, return_inverse=True)
            codes.append(sum(map(len, terms)) + inverse)
            terms.append(_joined(words, *numbers))
            ats.append(at)
    at = np.concatenate(ats)
    return pa.concat_arrays(terms), np.concatenate(codes), row[at], place[at]


def _with_synonyms(words: pa.Array, code, row, place, synonyms: list[tuple[str, str]]):
    """Every term's occurrences are its synonyms', too."""
    source = pc.index_in(pa.array([a for a, _ in synonyms], pa.string()), words)
    here = np.flatnonzero(source.is_valid().to_numpy(zero_copy_only=False))
    if not len(here):
        return words, code, row, place
    target = pa.array([synonyms[k][1] for k in here], pa.string())
    fresh = target.filter(pc.invert(pc.is_in(target, words))).unique()
    words = pa.concat_arrays([words, fresh])
    target, source = pc.index_in(target, words).to_numpy(), source.take(pa.array(here)).to_numpy()
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    first, last = np.searchsorted(source, code, "left"), np.searchsorted(source, code, "right")
    at = np.repeat(np.arange(len(code)), last - first)
    within = np.arange(len(at)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    return words, np.concatenate([code, target[first[at] + within]]), np.concatenate([row, row[at]]), np.concatenate([place, place[at]])


def bucket_of(term: str | bytes, buckets: int) -> int:
    return zlib.crc32(term.encode() if isinstance(term, str) else term) % buckets


def invert(block: Block, meta: IndexMeta, synonyms: list[tuple[str, str]], buckets: int, fields: int):
    """Postings by (bucket, term); terms in this order with bucket and document frequency; the sum of lengths."""
    coded = block.words.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(block.count)), block.count)
    place = np.arange(len(code)) - np.repeat(np.cumsum(block.count) - block.count, block.count)
    frequent = list(word_list(meta.frequent_words)) if meta.ngram_indexing else []
    if frequent:
        words, code, row, place = _with_ngrams(words, code, row, place, frequent, meta.ngram_indexing)
    grown = len(words)
    if synonyms:
        words, code, row, place = _with_synonyms(words, code, row, place, synonyms)
    bucket = np.fromiter((zlib.crc32(t) for t in words.cast(pa.binary()).to_pylist()), np.int64, len(words)) % buckets
    order = pc.sort_indices(pa.table({"b": bucket, "t": words}), sort_keys=[("b", "ascending"), ("t", "ascending")]).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    if synonyms and (len(words) > grown or len(code) > len(block.words)):
        at = np.lexsort((place, row, rank[code]))
        r = rank[code][at]
        fresh = np.append(True, (r[1:] != r[:-1]) | (row[at][1:] != row[at][:-1]) | (place[at][1:] != place[at][:-1]))
        at = at[fresh]
    else:  # a term's tokens are in the order of their rows and places
        key = rank[code] << 32 | np.arange(len(code))
        key.sort()
        at = key & (1 << 32) - 1
    r, row, place = rank[code[at]], row[at], place[at]
    start = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (row[1:] != row[:-1])))
    length = _quantized(block.count)
    r, own, ends = r[start], row[start], np.append(start, len(row))
    words, bucket = words.take(pa.array(order)), bucket[order]
    postings = pa.table(
        {
            "doc_id": block.ids.take(pa.array(own)),
            "field_id": pa.array(block.field[own].astype(np.int32)),
            "term": words.take(pa.array(r)),
            "tf": pa.array(np.diff(ends).astype(np.int32)),
            "dl": pa.array(length[own].astype(np.int32)),
            "positions": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))),
        }
    )
    many = r if fields == 1 else np.unique(r << 32 | block.doc[own]) >> 32
    return postings, np.searchsorted(bucket[r], np.arange(buckets + 1)), words, bucket, np.bincount(many, minlength=len(words)), int(length.sum())


TERMS = "bucket int, term string, df bigint, length bigint, file string"
_TERMS = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("df", pa.int64()), ("length", pa.int64()), ("file", pa.string())])


def write_postings(rows: DataFrame, path: str, meta: IndexMeta, synonyms: list[tuple[str, str]], buckets: int, fields: int) -> DataFrame:
    """Files of postings under a folder, by bucket; rows of TERMS: a block's terms with their frequency, its sum of lengths, the files.

    A file's name has the task's attempt: those that the rows don't name are left over from a failed one.
    """

    def write(batches):
        where, root = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        task = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for number, block in enumerate(blocks(batches, list(range(fields)), BLOCK)):
            postings, edges, words, bucket, df, length = invert(block, meta, synonyms, buckets, fields)
            files = []
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    where.create_dir(f"{root}/bucket={b}", recursive=True)
                    files.append(f"bucket={b}/part-{task}-{number:05d}.parquet")
                    with where.open_output_stream(f"{root}/{files[-1]}") as out:
                        pq.write_table(postings.slice(edges[b], edges[b + 1] - edges[b]), out, compression="zstd", compression_level=1, row_group_size=1 << 17, use_dictionary=["term", "tf", "dl", "field_id"], write_page_index=True, store_schema=False)
            n, k = len(words), len(files) + 1
            for at in range(0, n, 1 << 16):
                m = min(n - at, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at : at + m].astype(np.int32)), words.slice(at, m), pa.array(df[at : at + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string())], schema=_TERMS)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array([length] + [0] * (k - 1), pa.int64()), pa.array([None, *files], pa.string())], schema=_TERMS)

    return rows.mapInArrow(write, TERMS)


def with_synonyms(rows: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """Postings with those of every term's synonyms added, and regrouped where a document has both."""
    if synonyms is None:
        return rows
    extra = rows.join(F.broadcast(synonyms) if synonyms.count() < 100_000 else synonyms, "term").select("doc_id", "field_id", F.col("synonym").alias("term"), "tf", "dl", "positions")
    touched = synonyms.select(F.col("synonym").alias("term")).distinct()
    own = rows.join(touched, "term", "left_semi").select("doc_id", "field_id", "term", "tf", "dl", "positions")
    both = own.union(extra).groupBy("doc_id", "field_id", "term").agg(F.max("dl").alias("dl"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return rows.join(touched, "term", "left_anti").select("doc_id", "field_id", "term", "tf", "dl", "positions").union(both.select("doc_id", "field_id", "term", F.size("positions").alias("tf"), "dl", "positions"))


def synonym_pairs(groups, multiway: bool = True) -> list[tuple[str, str]]:
    """(term, synonym) of groups of equals; or of each group's first term with the others, where only the first is a key."""
    out = set()
    for terms in groups:
        terms = [t.lower() for t in terms]
        for i, a in enumerate(terms):
            if multiway or i == 0:
                out.update((a, b) for b in terms if b != a)
    return sorted(out)


def dictionary(rows: DataFrame, fields: int = 2) -> DataFrame:
    """term, df: documents that have a term in any field. A document has a term once a field, so that rows are counted where there is one field."""
    return rows.groupBy("term").agg((F.count("*") if fields == 1 else F.count_distinct("doc_id")).alias("df"))


_GRAM = pa.schema([("gram", pa.string()), ("n", pa.int64())])
_PART = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("grams", pa.binary())])
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _grams(block: Block, parts: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, pairs and triples that completion offers, how often, and the part that a gram's words put it in; by part."""
    coded = block.words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words, v = coded.dictionary.take(order), len(order)
    rank = np.empty(v, np.int64)
    rank[order.to_numpy()] = np.arange(v)
    code, row = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(block.count)), block.count)
    long = pc.utf8_length(words).to_numpy() > 1
    single = long & ~pc.utf8_is_decimal(words).to_numpy(zero_copy_only=False)
    crc = np.fromiter((zlib.crc32(t) for t in words.cast(pa.binary()).to_pylist()), np.uint64, v)
    one, n1 = np.unique(code[single[code]], return_counts=True)
    at = np.flatnonzero((row[:-1] == row[1:]) & long[code[:-1]])
    two, n2 = _pairs(code[at], code[at + 1], v, return_counts=True)
    at = np.flatnonzero((row[:-2] == row[2:]) & long[code[1:-1]])
    three, n3 = _triples(code[at], code[at + 1], code[at + 2], v, return_counts=True)
    grams, hashes = [], []
    for numbers in ((one,), two, three):
        grams.append(_joined(words, *numbers))
        hashes.append(sum(crc[k] * m for k, m in zip(numbers, _MIX)))
    h = np.concatenate(hashes)
    part = ((h ^ h >> np.uint64(29)) * _MIX[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    return pa.concat_arrays(grams).take(pa.array(order)), np.concatenate([n1, n2, n3])[order], part[order].astype(np.int64)


def _packed(fields: list[int], parts: int):
    """Compressed rows: the grams of a block that belong to a part. Number, lengths, counts, and bytes of the strings."""

    def pack(batches):
        codec = pa.Codec("zstd", 1)
        for block in blocks(batches, fields, GRAM_BLOCK):
            grams, n, part = _grams(block, parts)
            offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1]
            text, edges = memoryview(grams.buffers()[2] or b""), np.searchsorted(part, np.arange(parts + 1))
            lengths, n, rows = np.diff(offsets).astype(np.int32), n.astype(np.int32), ([], [], [])
            for p in np.flatnonzero(np.diff(edges)).tolist():
                a, z = edges[p], edges[p + 1]
                raw = b"".join([np.int32(z - a).tobytes(), lengths[a:z].tobytes(), n[a:z].tobytes(), text[offsets[a] : offsets[z]]])
                for values, x in zip(rows, (p, len(raw), codec.compress(raw, asbytes=True))):
                    values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _PART)], schema=_PART)

    return pack


def _added(batches):
    """The grams of a part with their sums."""
    codec, held = pa.Codec("zstd"), []
    for b in batches:
        for size, packed in zip(b.column("size").to_pylist(), b.column("grams")):
            raw = codec.decompress(packed.as_buffer(), decompressed_size=size)
            k = int(np.frombuffer(raw, np.int32, 1)[0])
            offsets = np.zeros(k + 1, np.int32)
            np.cumsum(np.frombuffer(raw, np.int32, k, 4), out=offsets[1:])
            held.append(pa.table({"gram": pa.StringArray.from_buffers(k, pa.py_buffer(offsets), raw.slice(4 + 8 * k)), "n": np.frombuffer(raw, np.int32, k, 4 + 4 * k).astype(np.int64)}))
    if held:
        out = pa.concat_tables(held).group_by("gram", use_threads=False).aggregate([("n", "sum")])
        held.clear()
        for r in out.select(["gram", "n_sum"]).rename_columns(["gram", "n"]).cast(_GRAM).to_batches(max_chunksize=1 << 16):
            yield r


def completions(rows: DataFrame, fields: list[int], tokens: int) -> DataFrame:
    """gram, n: frequency of words of over one character that aren't numbers, of pairs whose first and triples whose middle word has over one character.

    rows: field_rows of the fields; tokens: about how many they have. What is shuffled is a block's distinct
    grams, compressed, to parts of a bounded number of tokens.
    """
    parts = max(1, -(-tokens // GRAM_PART), rows.sparkSession.sparkContext.defaultParallelism)
    packed = rows.mapInArrow(_packed(fields, parts), "part int, size int, grams binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(_added, "gram string, n bigint")


def most_frequent(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of at most ``most`` that have the highest numbers; of equal numbers at the limit, none. The driver sees a count for each number."""
    counts = sorted(map(tuple, rows.groupBy(column).agg(F.count("*")).collect()), reverse=True)
    total = 0
    for value, n in counts:
        total += n
        if total > most:
            return rows.where(F.col(column) > F.lit(value))
    return rows
