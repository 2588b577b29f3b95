"""Token ids in Arrow stream files of fixed-size-list batches, and their way back.

Each file is one Arrow IPC stream. Its batches hold ``ids`` (fixed-size lists of SEQ_LEN ids) and ``mask`` (fixed-size lists
of SEQ_LEN booleans, false for the padding that ends a file). Batches are uncompressed and all sequences are equally long, so
sequence k of a memory-mapped file is a zero-copy slice at a computed place. Beside it lies an index stream with
(doc_id, at, n_tokens): where in the file's ids each document begins. Files are numbered in ascending doc_id order.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from urllib.parse import urlsplit

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import fresh_path, small_batches, stage, worker_cache

SEQ_LEN = 2048
BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_END = 2
#: Memoized pieces of text per Python worker; beyond it the memo starts anew.
MEMO_PIECES = 1_000_000

#: Stands for a piece whose ids depend on its neighbours.
ODD = 0
_encoders: dict[tuple[str, bool], Encoder] = worker_cache()


class Encoder:
    """Ids of whole texts as little-endian bytes, equal to one call of the tokenizer on each whole text.

    A byte-level tokenizer never lets a token cross into a single space between two printing characters, and one that drops
    white space never crosses any; so texts are cut there, and each distinct piece is encoded once. Neither has tokens across
    the end of a letter run, so a piece's closing punctuation, and what follows a line break, are encoded apart.
    """

    #: ASCII marks that end a run of letters; not the apostrophe, which may begin a contraction.
    MARKS = '.,;:!?#$%&*|()"'

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # pieces are encoded many at a time, told apart by a token of its own that they don't hold
        self.between = " \x01 " if drops_space else "\n"
        (self.mark,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes | int] = self.first if drops_space else {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _encode_all(self, memo: dict, pieces: list[str], lead: str) -> None:
        plain = [p for p in pieces if p and self.between.strip(" ") not in p]
        for p in set(pieces).difference(plain):
            memo[p] = self._ids(lead + p).tobytes() if p else b""
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            ids = self._ids(lead + (self.between + lead).join(some))
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(cuts) == len(some) + 1:
                data, width = ids.tobytes(), self.kind.itemsize
                memo.update((p, data[(i + 1) * width : j * width]) for p, i, j in zip(some, cuts, cuts[1:]))
            else:  # a token of the pieces' own looks like the mark
                memo.update((p, self._ids(lead + p).tobytes()) for p in some)

    def _learn(self, memo: dict, pieces: set[str], lead: str) -> None:
        whole = [p for p in pieces if p[-1:].isalnum() and "\n" not in p]
        joined = []
        for p in pieces.difference(whole):
            core, tail = p, ""
            if "\n" in p:
                core, tail = p.split("\n", 1)
                if not core or not tail or core[-1].isspace() or tail[0].isspace():
                    core, tail = p, ""
                else:
                    tail = "\n" + tail
            else:
                core = p.rstrip(self.MARKS)
                core, tail = (core, p[len(core) :]) if core[-1:].lower()[-1:].isalpha() else (p, "")
            joined.append((p, core, tail)) if tail else whole.append(p)
        if joined:
            self._learn(memo, {c for _, c, _ in joined}.difference(memo, whole), lead)
            lines = {t[1:] for _, _, t in joined if t[0] == "\n"}
            self._learn(self.first, lines.union(t for _, _, t in joined if t[0] != "\n").difference(self.first), "")
        self._encode_all(memo, whole, lead)
        if not self.drops_space:
            newline = self._ids("\n").tobytes()
            for p, c, t in joined:
                memo[p] = ODD if memo[c] is ODD else memo[c] + (newline + self.first[t[1:]] if t[0] == "\n" else self.first[t])
            if lead:  # next to other white space a cut could fall within a token; such texts are encoded whole
                memo.update((p, ODD) for p in pieces if not p or len(p.strip()) < len(p))
        else:
            memo.update((p, memo[c] + self.first[t]) for p, c, t in joined)

    def _without_marks(self, pieces: pa.Array) -> tuple[pa.DictionaryArray, list[str], np.ndarray]:
        """Pieces without the marks that follow a closing letter, the distinct runs of such marks ('' first), and each piece's run."""
        core = pc.utf8_rtrim(pieces, characters=self.MARKS)
        size = pc.subtract(pc.binary_length(pieces), pc.binary_length(core)).to_numpy()
        ends_well = pc.match_substring_regex(core, r"[A-Za-z\p{Ll}]$").to_numpy(zero_copy_only=False)
        size = np.where(ends_well & (size <= 8), size, 0)
        core = pc.if_else(pa.array(size > 0), core, pieces)
        tails, at = {"": 0}, np.zeros(len(size), np.int32)
        for k in np.unique(size[size > 0]).tolist():
            runs = pc.utf8_slice_codeunits(pieces.filter(pa.array(size == k)), -k).dictionary_encode()
            place = np.array([tails.setdefault(t, len(tails)) for t in runs.dictionary.to_pylist()], np.int32)
            at[size == k] = place[runs.indices.to_numpy()]
        return core.dictionary_encode(), list(tails), at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts without nulls, and how many each text has."""
        for memo in (self.first, self.later):
            if len(memo) > MEMO_PIECES:
                memo.clear()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if self.drops_space else texts, " ")
        bounds = np.cumsum([0, *cut.value_lengths().to_numpy()])
        words = cut.flatten().dictionary_encode()
        del cut
        at, distinct = words.indices.to_numpy().copy(), words.dictionary
        del words
        cores, tails, tail_at = self._without_marks(distinct)
        core_at, core = cores.indices, cores.dictionary.to_pylist()
        odd, heads = np.zeros(len(texts), bool), []
        if not self.drops_space:
            heads = distinct.take(pa.array(at[bounds[:-1]])).to_pylist()
            self._learn(self.first, set(heads).difference(self.first), "")
            odd |= np.array([not h or h[-1].isspace() for h in heads], bool) & (np.diff(bounds) > 1)
            at[bounds[:-1]] = len(distinct) + np.arange(len(heads))
        known = list(map(self.later.get, core))
        new = [i for i, k in enumerate(known) if k is None]
        self._learn(self.later, {core[i] for i in new}, "" if self.drops_space else " ")
        for i in new:
            known[i] = self.later[core[i]]
        strange = [i for i, k in enumerate(known) if k is ODD]
        if strange:
            odd |= np.logical_or.reduceat(np.isin(at, np.flatnonzero(np.isin(core_at.to_numpy(), strange))), bounds[:-1])
            for i in strange:
                known[i] = b""
        self._learn(self.first, set(tails).difference(self.first), "")
        kind = pa.large_binary() if texts.nbytes > 1 << 28 else pa.binary()
        whole = pc.binary_join_element_wise(pa.array(known, kind).take(core_at), pa.array([self.first[t] for t in tails], kind).take(pa.array(tail_at)), pa.scalar(b"", kind))
        taken = pa.concat_arrays([whole, pa.array([self.first[h] for h in heads], kind)]).take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], np.int64 if kind == pa.large_binary() else np.int32, len(at) + 1)
        ids = np.frombuffer(taken.buffers()[2] or b"", self.kind, ends[-1] // self.kind.itemsize)
        counts = np.diff(ends[bounds]).astype(np.int64) // self.kind.itemsize
        if not odd.any():
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.kind)
        return np.concatenate(parts), np.array([len(x) for x in parts])


def encoder(path: str, drops_space: bool = False) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = Encoder(path, drops_space)
    return _encoders[path, drops_space]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (pafs.LocalFileSystem(), uri)


class _StreamWriter:
    """Cuts a run of ids into fixed-size lists; memory is one batch."""

    def __init__(self, sink, kind: np.dtype, seq_len: int, batch_sequences: int = 256):
        self.kind, self.seq_len, self.room = kind, seq_len, seq_len * batch_sequences
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", value, False), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), seq_len))])
        self.out, self.held, self.size = pa.ipc.new_stream(sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.room:
            run = np.concatenate(self.held)
            whole = len(run) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(run[at : at + self.room], self.room)
            self.held, self.size = [run[whole:]], len(run) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, np.arange(len(ids)) < real), self.schema)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            run = np.concatenate(self.held)
            pad = -len(run) % self.seq_len
            self._write(np.concatenate([run, np.zeros(pad, self.kind)]), len(run))
        self.out.close()


#: Bytes of the documents' own files that go to one token file at most, by the plan's estimate.
FILE_BYTES = 512 << 20

INDEX = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, drops_space: bool = False) -> DataFrame:
    """Write docs' ids into folder (a URI that all executors reach) and return the manifest (file, name, n_docs, n_tokens).

    Documents go in ascending id order, null ids first; rows that repeat an id are each written, as are null texts (as empty).
    A task writes under a name of its own and renames at its end, so a task that runs again leaves the same file.
    """
    spark = docs.sparkSession
    small_batches(spark, 4000, 12)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, by the plan; nothing is read
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES) if size < 1 << 60 else 0)
    ordered = picked.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, own = f"{base}/tokens-{number:06d}", uuid.uuid4().hex
        enc, writer, n_docs, n_tokens = encoder(tokenizer_path, drops_space), None, 0, 0
        with fs.open_output_stream(f"{name}.{own}.arrow") as tokens, fs.open_output_stream(f"{name}.{own}.index") as index:
            writer, listed = _StreamWriter(tokens, enc.kind, seq_len), pa.ipc.new_stream(index, INDEX)
            end = np.array([end_id], enc.kind)
            for b in batches:
                ids, counts = enc.encode(b.column(1))
                ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
                writer.add(ids)
                at = n_tokens + np.cumsum(counts) - counts
                n_tokens += int(counts.sum())
                n_docs += len(counts)
                listed.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64()), pa.array(counts, pa.int64())], schema=INDEX))
            writer.close()
            listed.close()
        for kind in ("arrow", "index"):
            fs.move(f"{name}.{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"number": [number], "name": [f"tokens-{number:06d}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return stage(ordered.mapInArrow(run, "number long, name string, n_docs long, n_tokens long"), "token-manifest")


class TokenFile:
    """Random access to one written file: ids of a range without reading what lies before it."""

    def __init__(self, folder: str, name: str):
        fs, base = _filesystem(folder)
        self.name = f"{base}/{name}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{self.name}.arrow") if local else fs.open_input_file(f"{self.name}.arrow")
        self.batches = []
        with pa.ipc.open_stream(self.source) as reader:
            self.seq_len = reader.schema.field("ids").type.list_size
            self.batches = list(reader)
        with fs.open_input_stream(f"{self.name}.index") as f, pa.ipc.open_stream(f) as reader:
            self.index = reader.read_all()
        self.starts = np.cumsum([0, *(b.num_rows * self.seq_len for b in self.batches)])

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of equal-length sequence k; the ids are a view of the file."""
        i = int(np.searchsorted(self.starts, k * self.seq_len, "right")) - 1
        at = k - self.starts[i] // self.seq_len
        ids, mask = (self.batches[i].column(c)[int(at)].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, at: int, count: int) -> np.ndarray:
        parts, i = [], int(np.searchsorted(self.starts, at, "right")) - 1
        while count > 0:
            lo = at - self.starts[i]
            got = self.batches[i].column(0).flatten().slice(int(lo), count).to_numpy()
            parts.append(got)
            at, count, i = at + len(got), count - len(got), i + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_token_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that manifest lists.

    start counts the ids of all documents in earlier files too; only one total a file passes through the driver.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.collect(), key=lambda r: r.number)
    before, rows = 0, []
    for r in files:
        if r.n_docs:
            rows.append((r.name, before))
        before += r.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(rows, "name string, before long").repartition(len(rows))

    def run(batches):
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile(folder, name)
                for part in f.index.to_batches(max_chunksize=10_000):
                    at, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crc = [zlib.crc32(f.ids(int(a), int(k)).astype("<u4").tobytes()) for a, k in zip(at, n)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at + first), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = BYTE_BPE_END) -> DataFrame:
    """Write docs' token files to the shared folder, read them back and return one digest row per document."""
    folder = fresh_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer_path or public_tokenizers.path(BYTE_BPE), end_id)
    return read_token_digests(folder, manifest)
