"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by id. Every task streams one part:
``<part>.ids`` holds the token ids of its documents, back to back, as
little-endian unsigned integers of the width the vocabulary needs;
``<part>.offsets`` holds one more unsigned 64-bit token offset than there are
documents; ``<part>.docs`` holds the document ids (signed 64-bit) and a byte
that is 1 for a null id. A part's name carries its task attempt, and only
attempts that ended well are in the manifest, so a retried task does no harm.
The bases of the parts are prefix sums over the manifest, one row a part.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import settle, shared_dir
from gristmill.llm.wordhash import slices

DOC = np.dtype([("id", "<i8"), ("null", "u1")])
MANIFEST = "part int, name string, docs long, tokens long"
#: Pieces of a generation. A worker remembers two: when one is full the older is let go.
REMEMBERED = 250_000


def letters_below_180(start: str) -> str:
    """Code points below U+0180 whose category begins so, for use in a character class."""
    return "".join(re.escape(chr(p)) for p in range(0x180) if unicodedata.category(chr(p))[0] == start)


spaces_below_180 = r"\t-\r \x85\xa0"
#: The vocabulary's own pre-tokenisation for lower-case text below U+0180, where it is plain.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters_below_180('L')}]+|[{letters_below_180('N')}]|[^{spaces_below_180}{letters_below_180('L')}{letters_below_180('N')}]+")
#: What a tokenizer file must say for its pieces to be those; any other one encodes texts whole.
_PRE_TOKENIZER = [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True), ("ByteLevel", None, None, None)]
_NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u017f]|<\\|")
_WHITE = re.compile(r"[\t-\r ]+")


def _in_pieces(tokenizer) -> bool:
    """Whether the tokenizer normalises and cuts texts in the way that PieceEncoder follows."""
    said = json.loads(tokenizer.to_str())
    cuts = [(p["type"], (p.get("pattern") or {}).get("Regex"), p.get("behavior"), p.get("invert")) for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    folds = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (said.get("normalizer") or {}).get("normalizers", [])]
    return cuts == _PRE_TOKENIZER and folds == _NORMALIZER


class PieceEncoder:
    """Encodes whole texts through a memory of pieces that the tokenizer treats independently.

    This holds for vocabularies that cut texts by ``_PRE_TOKENIZER``; with any
    other one, whole texts go to the tokenizer.

    Text below U+0180 is lower-cased and cut as the vocabulary's pre-tokeniser
    cuts it. Any other text, and any with a mark that may begin a special
    token, is cut at ASCII white space only, which the vocabulary drops.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        self.end = np.array([end_id], dtype=self.type).tobytes()
        self.code = "H" if self.type.itemsize == 2 else "I"
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.in_pieces = _in_pieces(self.tokenizer)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn_together(self, part: list[str]) -> None:
        """Encode many pieces as one text; the vocabulary marks the last token of each."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(part) and ends[-1] == len(ids):
            raw, at = ids.astype(self.type).tobytes(), (ends * self.type.itemsize).tolist()
            self.known.update((p, raw[s:e]) for p, s, e in zip(part, [0, *at[:-1]], at, strict=True))

    def _learn(self, part: list[str]) -> None:
        for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            ids = array(self.code, e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            self.known[piece] = ids.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text and the end id, as bytes of the file's integer type."""
        if not self.in_pieces:
            return [np.array(e.ids, dtype=self.type).tobytes() + self.end for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        cut = [_WHITE.split(t) if ("<|" in t if t.isascii() else _NOT_PLAIN.search(t)) else _PIECES.findall(t.lower()) for t in (x or "" for x in texts)]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        fresh = set().union(*cut).difference(self.known)
        again = [p for p in fresh if p in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = list(fresh.difference(again))
        single = [p for p in new if _PIECES.fullmatch(p)] if self.closes.any() else []
        for lo in range(0, len(single), 1000):
            self._learn_together(single[lo : lo + 1000])
        self._learn([p for p in new if p not in self.known])
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) + self.end for pieces in cut]


def write(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write all documents in ascending id order; (folder, manifest with base).

    A null text is empty and yields the end id alone; null ids come first; rows
    that repeat an id are written each, ordered by the hash of their text, so
    that reruns agree. Texts of any length are encoded whole; other columns are
    ignored; an empty table gives an empty manifest. The folder is below the
    shared folder unless given, and the manifest lies in it as Parquet.
    """
    spark = docs.sparkSession
    out_dir = (out_dir or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    uri = out_dir if "://" in out_dir or out_dir.startswith("file:") else f"file://{out_dir}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, store, root = None, *pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        docs_done = tokens = 0
        for b in batches:
            if not b.num_rows:
                continue
            if encoder is None:
                encoder = PieceEncoder(tokenizer_path, end_id)
                store.create_dir(root, recursive=True)
                ids, offsets, owners = (store.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "offsets", "docs"))
                offsets.write(np.zeros(1, "<u8").tobytes())
            texts = b.column(1).to_pylist()
            owner = np.zeros(b.num_rows, dtype=DOC)
            owner["id"], owner["null"] = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False)
            owners.write(owner.tobytes())
            for lo, hi in slices(texts):
                coded = encoder.encode(texts[lo:hi])
                ids.write(b"".join(coded))
                upto = tokens + np.cumsum([len(c) // encoder.type.itemsize for c in coded])
                offsets.write(upto.astype("<u8").tobytes())
                tokens = int(upto[-1])
            docs_done += b.num_rows
        if encoder is not None:
            for f in (ids, offsets, owners):
                f.close()
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"{name}:{encoder.type.itemsize}"]), pa.array([docs_done]), pa.array([tokens])], ["part", "name", "docs", "tokens"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    written = settle(rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").drop("tie").mapInArrow(run, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    manifest.write.mode("overwrite").parquet(f"{uri}/manifest")
    return uri, spark.read.parquet(f"{uri}/manifest")


def read(uri: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from memory-mapped files.

    start counts the ids of all documents before it; ids_crc32 is over the ids
    as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        local = isinstance(store, pafs.LocalFileSystem)

        def part(path: str, kind, first: int, last: int) -> np.ndarray:
            """Elements first to last of a file: mapped where it is local, else that range alone is read."""
            if local:
                return np.memmap(path, dtype=kind, mode="r")[first:last]
            size = np.dtype(kind).itemsize
            with store.open_input_file(path) as f:
                return np.frombuffer(f.read_at((last - first) * size, first * size), dtype=kind)

        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                name, width = name.split(":")
                total = store.get_file_info(f"{root}/{name}.docs").size // DOC.itemsize
                for lo in range(0, total, 2000):
                    own = part(f"{root}/{name}.docs", DOC, lo, min(total, lo + 2000))
                    at = part(f"{root}/{name}.offsets", "<u8", lo, lo + len(own) + 1).astype(np.int64)
                    ids = part(f"{root}/{name}.ids", f"<u{width}", int(at[0]), int(at[-1]))
                    sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                    yield pa.record_batch([pa.array(own["id"], mask=own["null"] == 1), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    count = max(1, manifest.count())
    return manifest.select("name", "base").repartition(count).mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
