"""What the corpus operators share: scratch tables, words, hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's and DuckDB's regular expressions: no ASCII white space in it.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all run on this machine (tests) is a folder of our own made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}-{label}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and a lost
    executor costs a reread rather than a recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(make, label: str, before: str | None = None) -> tuple[DataFrame, str]:
    """``make()`` as a stored table, and its path. The tables that were stored on the way, and the one at ``before``,
    are deleted: nothing needs them any more."""
    first = len(_scratch)
    df = written(make(), label)
    (_, path), made = _scratch[-1], _scratch[first:-1]
    for x in [*made, *(x for x in _scratch if x[1] == before)]:
        _delete(*x)
        _scratch.remove(x)
    return df, path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for x in _scratch:
        try:
            _delete(*x)
        except Exception:  # the session is gone; the folder's owner removes it
            return


#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 20_000


def few(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if its rows are few, as counted; a larger table is joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tidy(run):
    """``run`` for mapInArrow, after which the worker, which stays for later tasks, gives freed memory back."""

    def wrapped(batches):
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


#: Odd, so that it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE_INV)]), dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes wherever they stand.

    It is a polynomial modulo 2**64, so words of a thousand bytes and more that are made for it (Thue-Morse
    sequences) may have one hash; such words count as equal.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    _grow(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64) * _M2)


def utf8(text: str | None, lower: bool = False) -> np.ndarray:
    """Bytes of a text, ASCII capitals lowered where asked."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _LOWER[raw] if lower else raw


_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


#: ASCII marks as spaces.
_BARE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(texts: list[str | None], lower: bool = False, bare: bool = False) -> list[np.ndarray]:
    """Hashes of the words of each text, in their order; the texts are hashed in one go. ``bare``: ASCII marks part words."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if bare:
        raws = [r.translate(_BARE) for r in raws]
    raw = np.frombuffer(b" ".join(raws), np.uint8)
    starts, ends = word_spans(raw)
    hashes = word_hashes(_LOWER[raw] if lower else raw, starts, ends)
    at = np.cumsum([len(x) + 1 for x in raws])
    return np.split(hashes, np.searchsorted(starts, at[:-1])) if len(raws) else []


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; of a shorter text, the hash of all its words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _MULT[0] + words[j : n - k + 1 + j] * _MULT[j % len(_MULT)]
    return mix64(out)
