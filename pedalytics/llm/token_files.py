"""Token ids of all documents as files of directly addressable codes, in document order."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedalytics.llm.common import shared_root
from pedalytics.llm.direct_codes import DirectCodes, encode
from pedalytics.llm.packing import END_ID, Encoder, added_tokens
from pedalytics.sources.files import qualified
from pedalytics.sources.fs import resolve, write_bytes

SUFFIX = ".dac"
STRIPE = 1 << 16           # tokens per step in which a token's file is looked up
KEEP_WORDS = 400_000       # words whose ids a worker remembers before it starts afresh
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
INDEX = "file string, part long, seq long, documents long, tokens long"
_BY_FILE: dict[tuple, "WordEncoder"] = {}


class WordIds(dict):
    """Ids of pieces between single spaces, found when first asked for (None: the piece needs its neighbours).

    Letters, letters with marks behind them, and two such words with a line
    break between them are cut into pre-tokens here, as the vocabulary's
    pattern cuts them; all else goes through the pattern.
    """

    def __init__(self, plain: Encoder):
        self.plain, self.single, self.marks = plain, plain.bpe._core_bpe.encode_single_piece, {}

    def _one(self, text: str) -> bytes:
        return array("H", self.single(text.encode())).tobytes()

    def _word(self, piece: str, space: str) -> bytes | None:
        letters = piece.rstrip(MARKS)
        if not letters.isalpha():
            return None
        marks = piece[len(letters):]
        if marks and marks not in self.marks:
            self.marks[marks] = self._one(marks)
        return self._one(space + letters) + (self.marks[marks] if marks else b"")

    def __missing__(self, piece: str) -> bytes | None:
        ids = self._word(piece, " ")
        if ids is None:
            above, line_break, below = piece.partition("\n")
            first, second = (self._word(above, " "), self._word(below, "")) if line_break else (None, None)
            if first is not None and second is not None:
                ids = first + self._one("\n") + second
            elif piece and not piece[0].isspace() and not piece[-1].isspace():
                ids = self.plain.raw(" " + piece)
        self[piece] = ids
        return ids


class WordEncoder(Encoder):
    """The same ids as ``Encoder``, at two thirds of its time where many words are rare."""

    def __init__(self, ranks_path: str, added: tuple[tuple[str, int], ...]):
        super().__init__(ranks_path, added)
        self.words = WordIds(self)

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
            self.words.marks.clear()
        found = list(map(self.words.__getitem__, rest))
        if None in found or (rest and (not first or first[-1].isspace())):
            return b"".join(self._joined([first, *rest], [None, *found]))
        return self.raw(first) + b"".join(found)


def word_encoder(*source) -> WordEncoder:
    if source not in _BY_FILE:
        _BY_FILE[source] = WordEncoder(*source)
    return _BY_FILE[source]


def write_token_files(df: DataFrame, root: str | None = None, ranks_path: str | None = None, json_path: str | None = None,
                      file_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents (null text: empty) and write their ids, ascending by id, as files under a new folder.

    Texts are shuffled by ranges of (id, hash of text, row), so equal ids and
    equal rows can lie in several ranges; their number follows from the bytes
    of all texts.  The task of a range encodes its texts in order and writes
    files of about ``file_tokens`` tokens (a document is never cut), which
    bounds its memory.  File names are unique to the attempt and only files of
    finished tasks are in the index (a table of file, order, documents and
    tokens), so a task that is run again leaves nothing that is read.  Returns
    the folder.

    Null ids come first, repeated ids and rows are documents of their own, and
    an empty table writes an index without rows.
    """
    spark = df.sparkSession
    if ranks_path is None:
        import public_tokenizers
        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    added = added_tokens(json_path) if json_path else ()
    folder = qualified(spark, f"{root or shared_root(spark)}/token-files-{uuid.uuid4().hex[:12]}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).first()[0] or 0
    ranges = max(1, -(-total // (4 * file_tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, context, end = word_encoder(ranks_path, added), TaskContext.get(), np.array([END_ID], "<u2").tobytes()
        part, attempt = context.partitionId(), context.taskAttemptId()
        keys, raw, tokens, seq = [], [], 0, 0

        def write() -> pa.RecordBatch:
            name = f"part-{part:07d}-{seq:05d}-{attempt}-{uuid.uuid4().hex[:8]}{SUFFIX}"
            starts = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])])
            write_bytes(f"{folder}/{name}", encode(
                np.frombuffer(b"".join(raw), "<u2"), starts, np.array([k or 0 for k in keys], np.int64),
                np.array([k is not None for k in keys])))
            return pa.RecordBatch.from_pylist(
                [{"file": name, "part": part, "seq": seq, "documents": len(keys), "tokens": tokens}])

        for batch in batches:
            for key, told in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                keys.append(key.as_py())
                raw.append(bpe.ids(told.as_py()).tobytes() + end)
                tokens += len(raw[-1]) // 2
                if tokens >= file_tokens:
                    yield write()
                    keys, raw, tokens, seq = [], [], 0, seq + 1
        if keys:
            yield write()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()) \
        .repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder in order with ``base``, the number of tokens in all files before.

    One row per file (millions of tokens), so one window over all of them stays small.
    """
    ahead = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("base", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (32-bit).

    Files are read by Spark's ``binaryFile`` source; a file's checksum is
    verified before it is used.
    """
    schema = "file string, doc_id long, first long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                codes = DirectCodes(content.as_buffer(), check=True)
                starts = codes.starts.astype(np.int64)
                every = codes.all().astype("<u4")
                raw = [every[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                cells = [pa.array([name.as_py()] * len(raw), pa.string()),
                         pa.array(codes.keys, pa.int64(), mask=~codes.known), pa.array(starts[:-1]),
                         pa.array(np.diff(starts)), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(cells + [pa.array(raw, pa.binary())] * with_ids,
                                                 [c.split()[0] for c in schema.split(", ")])

    index = token_index(spark, folder)
    if index.isEmpty():
        return spark.createDataFrame([], schema.replace("file string, ", "").replace("first", "start"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder) \
        .select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(run, schema)
    base = index.select(F.col("file").alias("of"), "base")
    return found.join(base, F.col("file") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """``position, token`` for rows of token places (over all documents); null where there is no such token.

    A place finds its file by an equality join on stripes of 65,536 tokens;
    each file is opened once per run of its rows and only the asked places are
    read from its levels.
    """
    index = token_index(spark, folder).withColumn("last", F.col("base") + F.col("tokens") - 1)
    stripes = index.select("file", "base", "last", F.explode(F.sequence(
        F.floor(F.col("base") / STRIPE), F.floor(F.col("last") / STRIPE))).alias("stripe"))
    asked = positions.select(F.col(position).cast("long").alias("position")).withColumn(
        "stripe", F.floor(F.col("position") / STRIPE))
    inside = (asked.stripe == stripes.stripe) & (F.col("position") >= F.col("base")) & (F.col("position") <= F.col("last"))
    placed = asked.join(stripes, inside, "left").select("position", "file", (F.col("position") - F.col("base")).alias("at")) \
        .sortWithinPartitions("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, codes = None, None
        for batch in batches:
            files, places = np.array(batch.column("file").to_pylist(), object), batch.column("at").to_pylist()
            token: list[int | None] = [None] * len(files)
            for name in dict.fromkeys(f for f in files if f is not None):
                if name != open_name:
                    system, path = resolve(f"{folder}/{name}")
                    with system.open_input_file(path) as source:
                        open_name, codes = name, DirectCodes(source.read_buffer())
                rows = np.flatnonzero(files == name)
                for i, t in zip(rows.tolist(), codes.ids(np.array([places[i] for i in rows])).tolist(), strict=True):
                    token[i] = t
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(token, pa.int64())], ["position", "token"])

    return placed.mapInArrow(run, "position long, token long")
