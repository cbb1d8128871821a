"""Session, scratch-table and word-code helpers that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make this package importable on the executors and keep Arrow batches small.

    The package is sent through Spark's own file server, so that executors need
    no shared folder for code.  256 rows a batch bound a worker's memory also
    where every text is very long.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tokentally-code-")
    path = os.path.join(folder, f"tokentally-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("tokentally", os.path.relpath(full, package)))
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.  Where it is unset, a temporary one if driver and executors are one process, else an error: executors don't see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master is {master})")
        base = "file://" + tempfile.mkdtemp(prefix="tokentally-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    return f"{base.rstrip('/')}/tokentally"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: list[str | Column], how: str = "inner", rows: int = 20_000) -> DataFrame:
    """``left`` joined with ``right`` by ``key``, of which left may hold any number of rows: beyond ``rows`` of them they are dealt to several tasks by ``spread``, other columns of left.

    Right has a row for each key, which goes to each of its tasks.  Only keys that
    are that frequent are listed, so the list has a ``rows``-th of left's rows at
    most; it is written, so that its size is known and the optimizer broadcasts it only if it is small.
    """
    many = materialize(left.groupBy(key).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_parts")).where("_parts > 1"), "many")
    part = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = left.join(many, key, "left").withColumn("_part", part).drop("_parts")
    copied = right.join(many, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(("file:", "hdfs:", "s3", "gs:", "abfs")) and "/tokentally/" in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text (crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(k))


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


#: Word separators of the contracts: space and U+0009 to U+000D.
_SEPARATORS = "\t\n\x0b\x0c\r"
_TO_SPACE = str.maketrans(_SEPARATORS, " " * len(_SEPARATORS))


def split_words(text: str) -> list[str]:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    if not text:
        return []
    return [w for w in text.translate(_TO_SPACE).split(" ") if w] if not _plain(text) else text.replace("\n", " ").split()


def _plain(text: str) -> bool:
    """Whether str.split() sees no separators besides those of the contracts."""
    return text.isascii() and not _ODD_ASCII.intersection(text) or not _ODD.intersection(text)


_ODD_ASCII = frozenset("\x1c\x1d\x1e\x1f")
_ODD = frozenset("\x1c\x1d\x1e\x1f\x85\xa0                　")


def hash64(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Codes:
    """A word's 64-bit code, remembered per worker process; the memory is bounded by ``limit`` words."""

    def __init__(self, code: Callable[[str], int] = hash64, limit: int = 300_000):
        self.code, self.limit, self.known = code, limit, {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = set(words).difference(known)
        code = self.code
        for w in new:
            known[w] = code(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_PROCESS: dict = {}


def per_process(key, make: Callable):
    """A value that is made once per worker process and kept for its later tasks, until another one is asked for: a worker serves one operator after the other, and what earlier ones remembered would fill its memory."""
    if key not in _PROCESS:
        for old in [k for k in _PROCESS if k != "powers"]:
            del _PROCESS[old]
        _PROCESS[key] = make()
    return _PROCESS[key]


def release(key) -> None:
    """Forget a value of per_process() and give its memory back: a driver that has trained a model goes on for hours with other memory needs."""
    _PROCESS.pop(key, None)
    give_back()


def give_back() -> None:
    """Give what the process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer, vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEPARATOR_BYTES = np.zeros(256, dtype=bool)
_SEPARATOR_BYTES[[9, 10, 11, 12, 13, 32]] = True
BYTE_CODES = np.random.default_rng(90210).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF97  # 3 modulo 4, so that differences of its powers keep nearly all bits


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each."""
    held = _PROCESS.get("powers")
    if held is None or len(held[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        held = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            with np.errstate(over="ignore"):
                while done < size:
                    out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
                    done *= 2
            held.append(out)
        _PROCESS["powers"] = held
    return held[0], held[1]


#: Bytes that are hashed, and symbols that are looked at, at a time: a long text is cut, and a part's arrays are many times its bytes.
AT_ONCE = 1_000_000
_SEPARATOR = re.compile(rb"[\t-\r ]")


def raw_parts(raw: Iterable[bytes], size: int = AT_ONCE) -> Iterator[list[tuple[int, bytes]]]:
    """(text number, bytes) of texts, or pieces of long ones cut at separators, together about ``size`` bytes at a time."""
    held, total = [], 0
    for i, r in enumerate(raw):
        at = 0
        while True:
            end = len(r)
            if end - at > size and (cut := _SEPARATOR.search(r, at + size)) is not None:
                end = cut.start()
            held.append((i, r[at:end] if at or end < len(r) else r))
            total += end - at + 1
            at = end
            if total >= size:
                yield held
                held, total = [], 0
            if at >= len(r):
                break
    if held:
        yield held


def word_hash_parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, text numbers, words of each of these) a part at a time; see word_hashes().  A text may lie in several parts."""
    for part in raw_parts((t or "").encode("utf-8", "surrogatepass").lower() for t in texts):
        b = np.frombuffer(b"\n".join([r for _, r in part]) + b"\n", dtype=np.uint8)
        gap = _SEPARATOR_BYTES[b]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edges = np.concatenate([[0], edges])
        first, end = edges[0::2], edges[1::2]
        up, down = powers(len(b))
        with np.errstate(over="ignore"):
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[b] * up[: len(b)], dtype=np.uint64)])
            hashes = mix64((prefix[end] - prefix[first]) * down[first] + (end - first).astype(np.uint64), 5)
        bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for _, r in part])])
        yield hashes, np.array([i for i, _ in part], dtype=np.int64), np.diff(np.searchsorted(first, bounds))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, see split_words()) in order, and the number of words of each text.

    A word's hash is a polynomial in random codes of its bytes, taken from prefix
    sums over a part of the batch, so no word is looked at alone.
    """
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for hashes, numbers, n in word_hash_parts(texts):
        out.append(hashes)
        np.add.at(counts, numbers, n)
    return (np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.uint64)), counts


def segments(lengths: Iterable[int]) -> np.ndarray:
    """Start positions of consecutive segments, with the end appended."""
    return np.concatenate([[0], np.cumsum(np.asarray(list(lengths), dtype=np.int64))])


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over segments [starts[i], starts[i+1]); empty segments give 0."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]
