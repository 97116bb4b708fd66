"""BPE encoding and decoding by a table of distinct words.

A word is a run of white space and the run of other characters after it, so
words end wherever white space begins; a byte-level tokenizer's pre-tokens
never reach over such a place, and a text's ids are those of its words. Added
tokens are words of their own.

Encoding: (1) Spark splits the texts into words, and tasks number them: a chunk
of about ``chunk_chars`` bytes of text is one row with its distinct words and
the words' numbers by document and position, packed. Chunks are written as a
table laid out by chunk, so everything after reads the same chunks whatever
executor is lost, and positions need not be shuffled.
(2) The distinct words of each chunk go, packed, to the bucket of their hash. A
bucket is a part of the table of distinct words: each of its words is encoded
once, and the chunks that asked get its ids. (3) A chunk's positions and its
words' ids meet; taking the ids at the positions gives the documents' ids.
Texts are never shuffled, and a frequent word costs an entry a chunk and not
one an occurrence. The number of buckets follows the number of distinct words,
estimated from the chunks' least hashes, at ``BUCKET_WORDS`` to each; so
neither a bucket's table nor a chunk grows with the input.

Decoding joins ids with the vocabulary's pieces. The table of pieces is bounded
by the vocabulary's file (50,257 pieces here) and broadcast, and a task joins a
batch of ids with it at once, by id. (A plan with a row for each id takes more
than the check tool's time; README has the figures.)

Everything is bounded by bytes. Texts with a run of ``LONG`` characters without
white space (minified code, scripts without spaces) are split within it as
well, where the byte-level pattern ends a token in any case: between a letter
or digit and a mark of punctuation. The library gets ``BATCH`` bytes of words
at once, or one word; the number of buckets follows the bytes of distinct words
as well as their number, and that of the chunk table's parts the texts' bytes.

Splitting at added tokens (their strings in a text count as the token), the
byte-level pattern and the merges of a word are the tokenizers library's, from
the vocabulary file.

Defined cases: a null or empty text has no ids; a text longer than a chunk is
a chunk of its own, which a task must hold; an empty table gives no rows;
repeated rows and null identifiers are encoded row by row; ``encode`` reads no
columns but the identifier and the text; ``decode`` keeps all columns and
refuses a text column that is there already; null ids give a null text, ids
that the vocabulary lacks give nothing, and bytes that are no UTF-8 give
U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from brindle.llm.memory import give_back
from brindle.llm.store import materialize_by

CHUNK_CHARS = 1 << 23
BUCKET_WORDS, BUCKET_BYTES = 1 << 17, 1 << 24
#: Bytes of text to each part of the chunk table, at least the session's number of parts.
PART_BYTES = 1 << 27
BATCH = 1 << 18
#: Texts with so long a run without white space are split at INNER places too.
LONG = 4096
INNER = r"(?<=[A-Za-z0-9\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3])(?=[.,;:!?(){}\[\]<>=+*/\\\u3001\u3002\uFF0C\uFF01\uFF1A\uFF1B\uFF1F])"
#: Least hashes of a chunk that the number of distinct words is estimated from.
LEAST = 256
CHUNK = "chunk bigint, least array<bigint>, n_words bigint, n_bytes bigint, words binary, numbers binary, ids array<{kind}>, lengths binary"


def added_tokens(vocabulary: str) -> list[str]:
    with open(vocabulary, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def byte_level(vocabulary: str) -> bool:
    """Whether the vocabulary's words are split by the byte-level pattern."""
    with open(vocabulary, encoding="utf-8") as f:
        split = json.load(f).get("pre_tokenizer") or {}
    return split.get("type") == "ByteLevel" and split.get("use_regex", True)


def words_of(text: Column, added: list[str], inner: bool = False) -> Column:
    """The words of a text, in order and without gaps."""
    text = F.coalesce(text, F.lit(""))
    plain = F.split(text, r"(?U)(?<=\S)(?=\s)", -1)
    if inner:
        plain = F.when(text.rlike(rf"(?U)(?<!\S)\S{{{LONG}}}"), F.split(text, rf"(?U)(?<=\S)(?=\s)|{INNER}", -1)).otherwise(plain)
    if not added:
        return plain
    token = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
    marked = F.regexp_extract_all(text, F.lit(rf"(?U)(?:{token})|(?:(?!{token})\s)*+(?:(?!{token})\S)++|(?:(?!{token})\s)++"), F.lit(0))
    holds = F.lit(False)
    for t in added:
        holds = holds | F.contains(text, F.lit(t))
    return F.when(holds, marked).otherwise(plain)


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed."""
    import zstandard

    planes = numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return planes.T.copy().view(np.uint32).ravel()


def pack_words(words: pa.Array) -> bytes:
    import zstandard

    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words.cast(pa.binary()).to_pylist()))


def unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)]) + 4 + 4 * n
    return [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _chunks(chunk_chars: int):
    """mapInArrow body: (id, words) rows as chunks. A chunk's words are the 255
    most frequent ones, then the next 65,280, then the others, in order within
    each, so that both the words and their numbers pack well."""

    def flush(chunk: int, words: list, ids: list, lengths: list) -> pa.RecordBatch:
        import xxhash

        coded = pa.chunked_array(words, pa.string()).dictionary_encode().combine_chunks()
        numbers, n = coded.indices.to_numpy(), len(coded.dictionary)
        often = np.empty(n, np.int64)
        often[np.argsort(-np.bincount(numbers, minlength=n), kind="stable")] = np.arange(n)
        kind = pa.array(np.searchsorted([255, 65_535], often, "right"))
        order = pc.sort_indices(pa.table({"kind": kind, "word": coded.dictionary}), [("kind", "ascending"), ("word", "ascending")]).to_numpy()
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        used, rows = coded.dictionary.take(pa.array(order)), pa.concat_arrays(ids)
        least = np.sort(np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in used.cast(pa.binary()).to_pylist()), np.int64, n))[:LEAST]
        size = int(pc.sum(pc.binary_length(used)).as_py() or 0)
        columns = [pa.array([chunk], pa.int64()), pa.array([least], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_words(used)], pa.binary()), pa.array([pack(rank[numbers])], pa.binary())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([pack(np.concatenate(lengths))], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "least", "n_words", "n_bytes", "words", "numbers", "ids", "lengths"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        words, ids, lengths, chars = [], [], [], 0
        for batch in batches:
            split = batch.column(1)
            n = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(split.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)])
            ends = sizes[np.cumsum(n, dtype=np.int64)]
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + chunk_chars - chars, "right")))
                part = batch.slice(start, stop - start)
                words.append(part.column(1).flatten())
                ids.append(part.column(0))
                lengths.append(n[start:stop])
                chars += int(ends[stop - 1]) - before
                start = stop
                if start < batch.num_rows or chars >= chunk_chars:
                    yield flush(chunk, words, ids, lengths)
                    chunk, words, ids, lengths, chars = chunk + 1, [], [], [], 0
                    give_back()
        if ids:
            yield flush(chunk, words, ids, lengths)
        words, ids, lengths = [], [], []
        give_back()

    return of


def distinct_words(chunks: DataFrame) -> int:
    """About how many distinct words the chunks have together."""
    least = [r["h"] for r in chunks.select(F.explode("least").alias("h")).distinct().orderBy("h").limit(LEAST).collect()]
    return len(least) if len(least) < LEAST else (LEAST - 1) * (1 << 63) // least[-1]


def bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))


def _requests(buckets: int):
    """mapInArrow body: (chunk, words) as packed words by bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = unpack_words(data.as_py())
                bucket = bucket_of(words, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts)).tolist()
                packed = [pack_words(pa.array([words[k] for k in order[cuts[b] : cuts[b + 1]]], pa.binary())) for b in used]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "bucket", "words"])
        give_back()

    return of


def _encode_words(vocabulary: str):
    """mapInArrow body over requests sorted by bucket: each distinct word of
    a bucket is encoded once, when first met. Answers go out every few MB."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        here, table = None, {}
        for batch in batches:
            start, counts, coded = 0, [], []
            for k, bucket in enumerate(batch.column(1).to_pylist()):
                if bucket != here:
                    here, table = bucket, {}
                words = unpack_words(batch.column(2)[k].as_py())
                fresh = [w for w in words if w not in table]
                cut = np.cumsum([len(w) for w in fresh], dtype=np.int64) // BATCH
                for part in np.split(np.arange(len(fresh)), np.flatnonzero(np.diff(cut)) + 1):
                    for w, e in zip((own := [fresh[i] for i in part.tolist()]), tokenizer.encode_batch([w.decode() for w in own], add_special_tokens=False), strict=True):
                        table[w] = np.array(e.ids, np.uint32).tobytes()
                found = [table[w] for w in words]
                counts.append(pack(np.fromiter(map(len, found), np.uint32, len(words)) // 4))
                coded.append(pack(np.frombuffer(b"".join(found), np.uint32)))
                if k + 1 == batch.num_rows or sum(map(len, coded)) > 4 << 20:
                    head = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*head.columns[:2], pa.array(counts, pa.binary()), pa.array(coded, pa.binary())], names=["of", "bucket", "counts", "word_ids"])
                    start, counts, coded = k + 1, [], []
        here, table, tokenizer = None, {}, None
        give_back()

    return of


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, used: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``used``, one after another, and where each word's
    end. Blocks of ``step`` words keep what is held besides small."""
    ends = np.cumsum(size[used], dtype=np.int64)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for at in range(0, len(used), step):
        block = used[at : at + step]
        n = size[block]
        stop = np.cumsum(n, dtype=np.int64)
        first = int(ends[at] - n[0])
        ids[first : first + int(stop[-1])] = flat[np.repeat(begin[block] - stop + n, n) + np.arange(stop[-1])]
    return ids, ends


def _put_together(buckets: int):
    """applyInArrow body: a chunk and its words' ids as its documents' ids."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("bucket", "ascending")]))
        nothing = [np.zeros(0, np.uint32)]
        counts = np.concatenate([unpack(c.as_py()) for c in right.column("counts")] or nothing).astype(np.int32)
        flat = np.concatenate([unpack(c.as_py()) for c in right.column("word_ids")] or nothing).astype(np.int32)
        rows, documents = [], []
        for k in range(left.num_rows):
            asked = bucket_of(unpack_words(left.column("words")[k].as_py()), buckets)
            place = np.empty(len(asked), np.int64)
            place[np.argsort(asked, kind="stable")] = np.arange(len(asked))
            begin = (np.cumsum(counts, dtype=np.int64) - counts)[place]
            ids, ends = _gathered(flat, begin, counts[place], unpack(left.column("numbers")[k].as_py()))
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(unpack(left.column("lengths")[k].as_py()), dtype=np.int64)])]
            documents.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))
            rows.append(left.column("ids")[k].values)
        made = pa.Table.from_arrays([pa.chunked_array(rows), pa.chunked_array(documents, pa.list_(pa.int32()))], names=["id", "ids"])
        del counts, flat, left, right, rows, documents
        give_back()
        return made

    return of


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", chunk_chars: int = CHUNK_CHARS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(id, ids): the token ids of every row of ``docs``. The texts are read
    once for their bytes and once for their words."""
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), words_of(F.col(text_column), added_tokens(vocabulary), byte_level(vocabulary)).alias("words"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_column)).cast("long")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    chunks = materialize_by(source.mapInArrow(_chunks(chunk_chars), CHUNK.format(kind=kind)), "chunks", "chunk", parts)
    distinct, each = distinct_words(chunks), chunks.agg(F.coalesce(F.sum("n_bytes") / F.sum("n_words"), F.lit(0.0))).first()[0]
    buckets = max(32, -(-distinct // bucket_words), int(distinct * each / BUCKET_BYTES) + 1)
    requests = chunks.select("chunk", "words").mapInArrow(_requests(buckets), "chunk bigint, bucket int, words binary")
    answers = requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(vocabulary), "of bigint, bucket int, counts binary, word_ids binary")
    return chunks.drop("least", "n_words", "n_bytes").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_put_together(buckets), f"id {kind}, ids array<int>")


def pieces(vocabulary: str) -> list[tuple[int, bytes]]:
    """The vocabulary's ids and the bytes that they stand for."""
    from tokenizers import Tokenizer

    # Byte level: printable bytes stand for themselves, the others for
    # characters from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char_of = {b: chr(b) for b in plain}
    char_of |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in char_of)}
    byte_of = {c: b for b, c in char_of.items()}
    vocab = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True)
    return [(i, bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()) for piece, i in vocab.items()]


def decode(coded: DataFrame, vocabulary: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids (array<int>)."""
    if text_column in coded.columns:
        raise ValueError(f"there is a column {text_column} already")
    table = pieces(vocabulary)
    # A vocabulary file bounds this table.
    sent = coded.sparkSession.sparkContext.broadcast((np.array([i for i, _ in table], np.int32), [p for _, p in table]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, piece = (pa.array(x) for x in sent.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_column))
            rows, nulls = range(len(ids)), pc.is_null(ids).to_pylist()
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            # The join: each id's place in the table of pieces, none if it lacks it.
            met = pc.fill_null(piece.take(pc.index_in(ids.flatten().cast(pa.int32()), value_set=known)), b"")
            ends = np.frombuffer(met.buffers()[1], np.int32, len(met) + 1, 4 * met.offset)
            bounds = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].tolist()
            data = memoryview(met.buffers()[2] or b"")
            texts = [None if nulls[k] else str(data[bounds[k] : bounds[k + 1]], "utf-8", "replace") for k in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_column])
        give_back()

    return coded.mapInArrow(of, StructType([*coded.schema.fields, StructField(text_column, StringType())]))


def digests(coded: DataFrame) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded) rows' digests of their ids."""
    return coded.select("id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
