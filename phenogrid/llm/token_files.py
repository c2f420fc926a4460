"""Token ids in flat binary files with 64-bit document offsets.

A store is a folder with, for each part, ``part-00000.bin`` (all ids, little-endian unsigned, 16
bits wide if the vocabulary allows, else 32), ``part-00000.idx`` (int64: where each document
starts in the part, and the part's length) and ``part-00000.ids`` (int64 document ids; the
smallest int64 stands for NULL). ``manifest.json`` has the parts in order with the number of
documents and ids before each, which are prefix sums over the parts.

Documents are dealt out by ranges of their id, so ids ascend over and inside the parts; each task
writes its part under a temporary name and renames it, so a repeated task replaces it by the same
bytes. Where a vocabulary's normaliser and pattern never look across an ASCII blank (``splits_at_blanks``
tries it), each worker encodes a word once and keeps the result in a cache of bounded size;
otherwise texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
_CACHED = 400_000
_LONGEST = 64
_BATCH = 8 << 20
_TOGETHER = 128
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf])+").fullmatch


def _fs(path: str):
    """File system and plain path of a local path or a URI, of the kind pyarrow can open."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


class Encoder:
    """Encodes texts to packed ids; words seen lately are kept in two generations.

    New words are encoded many at a time, joined by blanks. Where one word's ids end is told by the bytes
    that the tokens of a byte-level vocabulary stand for, which is certain for words of ``_PLAIN``
    characters: lower-casing keeps their size. Every end must be that of a token; if one isn't, or
    for other words, each word is encoded on its own. With ``by_words=False`` whole texts are encoded.
    """

    def __init__(self, vocabulary: str, wide: bool, by_words: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.by_words = by_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(tokens.values(), default=0) + 1, dtype=np.int64)
        for token, number in tokens.items():
            self.sizes[number] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)

    def _packed(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _joined(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of each word from one call for all; None where the ends aren't certain."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends, reached = np.cumsum([len(w) for w in words]), np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(reached, ends)
        if not len(reached) or reached[-1] != ends[-1] or (reached[cuts] != ends).any():
            return None
        blob, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        places = [0, *((cuts + 1) * width).tolist()]
        return [blob[i:j] for i, j in zip(places, places[1:])]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if _PLAIN(w)]
        known = set(plain)
        out, rest = {}, [w for w in words if w not in known]
        for at in range(0, len(plain), 256):
            some = plain[at:at + 256]
            found = self._joined(some)
            if found is None:
                rest += some
            else:
                out.update(zip(some, found))
        for at in range(0, len(rest), 1024):
            some = rest[at:at + 1024]
            out.update(zip(some, self._packed([w.decode() for w in some])))
        return out

    def __call__(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; the words that none before had are looked up and encoded together."""
        if not self.by_words:
            return self._packed([t or "" for t in texts])
        split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        known = self.young
        fresh = {w: self.old.get(w) for w in set().union(*split) if w not in known}
        fresh.update(self.encode_words([w for w, ids in fresh.items() if ids is None]))
        known.update(fresh)
        out = [b"".join([known[w] for w in words]) for words in split]
        for w in fresh:
            if len(w) > _LONGEST:
                del known[w]
        if len(known) > _CACHED:
            self.old, self.young = known, {}
        return out


def splits_at_blanks(encoder: Encoder) -> bool:
    """Whether the vocabulary gives a text's ids word by word, by a text of many kinds of words."""
    probe = "".join(f"{a}{b}{c}" for a in ("It's", "ÉCOLE", "12.5%", "漢字", "...", "e\u0301") for b in (" ", "\n\n", "\t ") for c in ("a", "'s", "1", "-", "ß", "Σ"))
    whole = encoder._packed([probe, f" {probe} "])
    return whole == [b"".join(encoder._packed([w.decode() for w in probe.encode().split()]))] * 2


_encoders: dict[tuple, Encoder] = {}


def _encoder(*kind) -> Encoder:
    if kind not in _encoders:
        _encoders.clear()
        _encoders[kind] = Encoder(*kind)
    return _encoders[kind]


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes the store of ``docs`` into the new folder ``path``; returns its manifest.

    ``end_id`` follows each document's ids. NULL and empty texts are documents with that id only;
    a NULL id comes first; rows with the same id are put in the order of their texts; other
    columns don't matter. An empty table gives a store without parts. Ids must be whole numbers, or texts
    of such; any other id raises.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    wide = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id) > 0xFFFF
    by_words = splits_at_blanks(_encoder(vocabulary, wide))
    fs, folder = _fs(path)
    fs.create_dir(folder, recursive=True)

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, folder = _fs(path)
        own = f"{folder}/.{part:05d}-{TaskContext.get().taskAttemptId()}"
        encode, end = _encoder(vocabulary, wide, by_words), np.array([end_id], dtype="<u4" if wide else "<u2").tobytes()
        starts, ids, at = [0], [], 0
        with fs.open_output_stream(f"{own}.bin") as out:
            for batch in batches:
                for some in range(0, len(batch[0]), _TOGETHER):
                    for doc, blob in zip(batch[0][some:some + _TOGETHER], encode.encode_all(batch[1][some:some + _TOGETHER])):
                        out.write(blob + end)
                        at += len(blob) // (4 if wide else 2) + 1
                        starts.append(at)
                        ids.append(NO_ID if pd.isna(doc) else int(doc))
        for name, values in (("idx", starts), ("ids", ids)):
            with fs.open_output_stream(f"{own}.{name}") as out:
                out.write(np.array(values, dtype="<i8").tobytes())
        for name in ("bin", "idx", "ids"):
            fs.move(f"{own}.{name}", f"{folder}/part-{part:05d}.{name}")
        yield pd.DataFrame({"part": [part], "n_docs": [len(ids)], "n_ids": [at]})

    def columns(batches):
        return write((b.iloc[:, 0].astype(object).tolist(), b.iloc[:, 1].tolist()) for b in batches)

    # ids as text survive pandas, which would turn a column with NULLs into floats
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    dealt = rows.repartitionByRange("_id", F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"), "_text")
    parts = dealt.select(F.col("_id").cast("string"), "_text").mapInPandas(columns, "part int, n_docs long, n_ids long")
    # one row a part: their number is that of the tasks, whatever they hold
    held = sorted((r for r in parts.collect() if r["n_docs"]), key=lambda r: r["part"])
    manifest = {"width": 4 if wide else 2, "parts": []}
    docs_before = ids_before = 0
    for r in held:
        manifest["parts"].append({"part": r["part"], "docs_before": docs_before, "n_docs": r["n_docs"],
                                  "ids_before": ids_before, "n_ids": r["n_ids"]})
        docs_before, ids_before = docs_before + r["n_docs"], ids_before + r["n_ids"]
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> dict:
    fs, folder = _fs(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, token_ids) of every document; ids as packed 32-bit little-endian.

    Files are memory-mapped where they are local, else read by range.
    """
    manifest = read_manifest(path)
    width, parts = manifest["width"], manifest["parts"]
    schema = f"`{id_col}` long, start long, n_tokens long, token_ids binary"
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches):
        fs, folder = _fs(path)
        for batch in batches:
            for part, before in zip(batch.column("part").to_pylist(), batch.column("ids_before").to_pylist()):
                name = f"{folder}/part-{part:05d}"
                with fs.open_input_file(f"{name}.ids") as f:
                    ids = np.frombuffer(f.read(), dtype="<i8")
                with fs.open_input_file(f"{name}.idx") as f:
                    starts = np.frombuffer(f.read(), dtype="<i8")
                local = isinstance(fs, pafs.LocalFileSystem)
                with pa.memory_map(f"{name}.bin") if local else fs.open_input_file(f"{name}.bin") as f:
                    at = 0
                    while at < len(ids):
                        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BATCH, side="right")) - 1)
                        to = min(to, len(ids))
                        f.seek(int(starts[at]) * width)
                        packed = np.frombuffer(f.read(int(starts[to] - starts[at]) * width), dtype=f"<u{width}").astype("<u4")
                        cuts = ((starts[at:to + 1] - starts[at]) * 4).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids[at:to], mask=ids[at:to] == NO_ID), pa.array(starts[at:to] + before),
                            pa.array(np.diff(starts[at:to + 1])),
                            pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(cuts), pa.py_buffer(packed)]).cast(pa.binary()),
                        ], names=[id_col, "start", "n_tokens", "token_ids"])
                        at = to

    listed = spark.createDataFrame([(p["part"], p["ids_before"]) for p in parts], "part int, ids_before long")
    return listed.repartition(len(parts), "part").mapInArrow(read, schema)
