"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by ranges of doc_id and sorted, so that file after file holds
them in ascending order. Each task encodes whole texts, appends the end id and packs
the stream into rows of ``length`` ids: an Arrow file (random-access stream format) whose record
batches have two fixed-size-list columns, ``ids`` (16 bits an id where the vocabulary
allows, else 32) and ``mask`` (a bit: true for a token, false for the padding of a file's last
row). A memory-mapped file gives any row without a copy. Beside it, a file
of the same name ending in ``.docs.arrow`` holds doc_id, start (inside the file) and n_tokens.

Files are written under a name of the attempt and then renamed, so a repeated task leaves
the same file. They go through the filesystem named by the path, which the executors share.
Only one row a file comes to the driver.

Texts are cut at spaces and line ends and before closing marks, where the tokenizer cuts as well, and each
distinct piece is encoded once per worker while a bounded memory of pieces lasts: the ids are those
of the whole text (for the lower-casing, space-dropping vocabulary that this is made for). Defined
cases: a null text is encoded as empty (the end id only); rows with equal doc_id are ordered by the
hash of their text; null ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

LENGTH, ROWS, END = 1024, 64, 1
#: Pieces that a worker remembers (about 200 bytes each); documents and characters encoded at a time (a longer text goes alone).
PIECES, DOCS, CHARS = 1_000_000, 4096, 8_000_000
#: Plain words encoded as one text, and such texts in one call.
JOINED, CALLS = 1024, 8
MARKS = punctuation


class Pieces:
    """The ids of text pieces, as little-endian bytes."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.known = tokenizer_path, Tokenizer.from_file(tokenizer_path), {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65536

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each text has.

        Arrow splits the texts and numbers their distinct pieces; only those are looked up, and numpy lays the ids out."""
        if not texts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        split = pc.split_pattern(pa.array([plain(t) for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        parts = list(map(self.known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) >> 2
        place = coded.indices.to_numpy()
        n = sizes[place]
        total = np.cumsum(n)
        kind = np.int32 if max(len(flat), total[-1]) < 2**31 else np.int64
        at = np.repeat(((np.cumsum(sizes) - sizes)[place] - (total - n)).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        return flat[at], np.add.reduceat(n, split.offsets.to_numpy()[:-1])

    def learn(self, distinct: list[str]) -> None:
        """Encode the pieces that aren't known yet."""
        if len(self.known) > PIECES:
            self.known = {"": b""}
        known = self.known
        fresh = [p for p in distinct if p not in known]
        bare = {p for p in fresh if p.isalpha() and p.islower()}  # their own cores
        new = {p: core(p) for p in fresh if p not in bare}
        bare |= {q for pair in new.values() for q in pair}.difference(known)
        words = [q for q in bare if q.isalpha() and (q.isascii() or q.lower().isalpha() and is_normalized("NFC", q))]
        for a in range(0, len(words), JOINED * CALLS):
            self._words([words[b : b + JOINED] for b in range(a, min(a + JOINED * CALLS, len(words)), JOINED)])
        self._each([q for q in bare if q not in known])
        for p, (word, marks) in new.items():
            known[p] = known[word] + known[marks]

    def _each(self, some: list[str]) -> None:
        for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, dtype="<u4").tobytes()

    def _words(self, groups: list[list[str]]) -> None:
        """Plain words, each group encoded as one text: the vocabulary marks the last token of each. If that doesn't give as many words, one by one."""
        for words, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(w) for w in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(words) or ends[-1] != 4 * len(ids):
                self._each(words)
                continue
            data, ends = ids.tobytes(), ends.tolist()
            self.known.update((word, data[a:b]) for word, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))


def plain(text: str) -> str:
    """The text with line ends as spaces and, if all ASCII, in lower case: the vocabulary's own normalisation, done once a text, so that fewer pieces differ."""
    low = text.lower() if text.isascii() and "<|" not in text else text
    return low.replace("\n", " ")


def core(piece: str) -> tuple[str, str]:
    """A piece as a word and the marks after it, which are tokens of their own; ASCII in lower case, as the vocabulary has it.
    A piece that may hold a special token stays whole."""
    if "<|" in piece:
        return piece, ""
    low = piece.lower() if piece.isascii() else piece
    word = low.rstrip(MARKS)
    return (word, low[len(word) :]) if word and word[-1].lower()[-1].isalnum() else (low, "")


_pieces: Pieces | None = None


def pieces(tokenizer_path: str) -> Pieces:
    import os

    global _pieces
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if _pieces is None or _pieces.path != tokenizer_path:
        _pieces = Pieces(tokenizer_path)
    return _pieces


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class FileWriter:
    """Packs documents into one file; holds one record batch at a time."""

    def __init__(self, sink: pa.NativeFile, docs_sink: pa.NativeFile, length: int, wide: bool = True):
        self.length, self.schema = length, sequence_schema(length, wide)
        self.kind = np.uint32 if wide else np.uint16
        self.out, self.docs = pa.ipc.new_file(sink, self.schema), pa.ipc.new_file(docs_sink, DOCS_SCHEMA)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.n_docs = 0
        self.index: tuple[list, list, list] = ([], [], [])

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with ``counts`` ids each, one after the other in ``ids``."""
        starts = self.total + np.cumsum(counts) - counts
        for column, values in zip(self.index, (doc_ids, starts.tolist(), counts.tolist()), strict=True):
            column.extend(values)
        self.total, self.n_docs = self.total + len(ids), self.n_docs + len(doc_ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.length * ROWS:
            self._flush(False)
        if len(self.index[0]) >= 65536:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype="<u4")
        n = -(-len(ids) // self.length) if last else len(ids) // (self.length * ROWS) * ROWS
        whole, rest = ids[: n * self.length], ids[n * self.length :]
        for a in range(0, n, ROWS):
            own = whole[a * self.length : (a + ROWS) * self.length]
            rows = -(-len(own) // self.length)
            full = np.zeros(rows * self.length, dtype=self.kind)
            mask = np.zeros(rows * self.length, dtype=bool)
            full[: len(own)], mask[: len(own)] = own, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.waiting, self.held = [rest.copy()], len(rest)

    def _flush_docs(self) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.index], schema=DOCS_SCHEMA))
        self.index = ([], [], [])

    def close(self) -> None:
        self._flush(True)
        self._flush_docs()
        self.out.close()
        self.docs.close()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, length: int = LENGTH, end: int = END) -> list[tuple[str, int, int]]:
    """Write all documents under ``path``; (file, documents, tokens) in order."""
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        own, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"part-{own:06d}"
        coder, writer, sinks = pieces(tokenizer_path), None, []
        for batch in it:
            for part in in_parts(batch):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    sinks = [files.open_output_stream(f"{root}/.{name}.{kind}.{attempt}") for kind in ("ids", "docs")]
                    writer = FileWriter(*sinks, length, coder.wide)
                ids, counts = coder.encode([t or "" for t in part.column(1).to_pylist()])
                writer.add(part.column(0).to_pylist(), np.insert(ids, np.cumsum(counts), end), counts + 1)
        if writer is not None:
            writer.close()
            for kind, sink in zip(("ids", "docs"), sinks, strict=True):
                sink.close()
                files.move(f"{root}/.{name}.{kind}.{attempt}", f"{root}/{name}.{kind}.arrow")
            yield pa.record_batch([pa.array([name]), pa.array([writer.n_docs]), pa.array([writer.total])], ["file", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id"))
    ordered = ordered.withColumn("_tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "_tie").drop("_tie")
    done = ordered.mapInArrow(write, "file string, n_docs long, n_tokens long").collect()
    return sorted((r["file"], r["n_docs"], r["n_tokens"]) for r in done)


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most DOCS documents and, but for single texts, CHARS characters."""
    held = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        before = held[a - 1] if a else 0
        b = max(a + 1, min(a + DOCS, int(np.searchsorted(held, before + CHARS, "right"))))
        yield batch.slice(a, b - a)
        a = b


def sequence(file: pa.NativeFile | pa.MemoryMappedFile, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of one row: views into the (memory-mapped) file, no copies.

    All batches but the last hold ROWS rows, so the row's batch is known without a search."""
    batch = pa.ipc.open_file(file).get_batch(row // ROWS)
    ids, mask = (batch.column(c).slice(row % ROWS, 1).flatten() for c in ("ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask


def documents_of(ids_file: pa.NativeFile, docs_file: pa.NativeFile) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
    """(doc_id, start, n_tokens, pieces of ids) for each document of a file, one record batch at a time."""
    reader, index = pa.ipc.open_file(ids_file), pa.ipc.open_file(docs_file)
    k, have = 0, np.zeros(0, dtype=np.uint16)
    for b in range(index.num_record_batches):
        batch = index.get_batch(b)
        for doc_id, start, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            got, need = [], n
            while need:
                if not len(have):
                    have = reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
                    k += 1
                got.append(have[:need])
                need -= len(got[-1])
                have = have[len(got[-1]) :]
            yield doc_id, start, n, got


def read_tokens(spark: SparkSession, path: str, written: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ``start`` counts all ids before."""
    bases = np.cumsum([0, *[n for _, _, n in written]]).tolist()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shared = spark.sparkContext.broadcast([(f, b) for (f, _, _), b in zip(written, bases, strict=False)])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        for batch in it:
            for own in batch.column(0).to_pylist():
                name, base = shared.value[own]
                rows: list[tuple] = []
                with files.open_input_file(f"{root}/{name}.ids.arrow") as a, files.open_input_file(f"{root}/{name}.docs.arrow") as b:
                    for doc_id, start, n, got in documents_of(a, b):
                        crc = 0
                        for piece in got:
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        rows.append((doc_id, base + start, n, crc))
                        if len(rows) >= 16384:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    n = len(written)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def query(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    return read_tokens(spark, path, write_tokens(docs, path, tokenizer_path))
