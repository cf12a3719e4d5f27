"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades: 0 toxic, 1 low quality, 2 good. One weight vector w is shared by all grades; ordered
thresholds give P(grade >= j) = sigmoid(w x - threshold_j). The expected grade is the sum of these,
and the last of them, the tail, is what documents are selected by.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import on_workers

#: Hash buckets, labelled rows taken of each grade (those of the least hash of their id), one
#: in how many documents of the sample must have a bucket, and steps of the fit.
BUCKETS, SAMPLE, LEAST, STEPS = 1 << 18, 4000, 500, 400
#: Standard errors by which a bucket's share must differ between grades.
SCREEN = 4.0
WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>{}[]=_~^\\@")] = True


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text: its words, and its shape in coarse steps. Null: as an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    words = WORD.findall(low)
    every = low.split()
    buf = np.frombuffer(raw, np.uint8)
    share = lambda a, b: int(20 * a / b) if b else -1
    lines = [x for x in text.split("\n") if x.strip()] if text else []
    upper = int(((buf >= 65) & (buf <= 90)).sum())
    shape = [
        f"\0len{len(every).bit_length()}",
        f"\0sym{share(SYMBOLS[buf].sum(), len(buf))}",
        f"\0up{share(upper, len(buf))}",
        f"\0dig{share(((buf >= 48) & (buf <= 57)).sum(), len(buf))}",
        f"\0bang{share((buf == 33).sum(), len(every))}",
        f"\0uniq{share(len(set(every)), len(every)) if len(every) > 50 else 'few'}",
        f"\0line{share(len(set(lines)), len(lines)) if len(lines) > 3 else 'few'}",
        f"\0odd{share(sum(1 for x in every if x[-1:] in b'*%$&#|<>'), len(every))}",
        f"\0mean{min(30, len(low) // max(1, len(every)))}",
    ]
    seen = set(words)
    return np.unique(np.fromiter((zlib.crc32(x) % BUCKETS for x in [*seen, *(s.encode() for s in shape)]), np.int64))


def fit(sets: list[np.ndarray], grade: np.ndarray, grades: int = 3, steps: int = STEPS, least: int = LEAST, l2: float = 1e-3, screen: float = SCREEN) -> dict:
    """Weights of the buckets and ordered thresholds, by Adam on the mean log likelihood."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    col = np.concatenate(sets) if n else np.empty(0, np.int64)
    count = np.bincount(col, minlength=BUCKETS)
    # Screening: buckets whose share of documents differs between the grades below and above a threshold.
    far = np.zeros(BUCKETS, bool)
    for j in range(1, grades if n else 1):
        up = grade >= j
        a, b = int(up.sum()), int(n - up.sum())
        if a and b:
            one = np.bincount(col[up[row]], minlength=BUCKETS)
            p = count / n
            far |= np.abs(one / a - (count - one) / b) > screen * np.sqrt(p * (1 - p) * (1 / a + 1 / b)) + 1e-12
    used = np.flatnonzero(far & (count >= max(2, n // least)))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    w, base, gap = np.zeros(len(used)), -1.0, np.zeros(grades - 2)
    m = [np.zeros_like(w), 0.0, np.zeros_like(gap)]
    v = [np.zeros_like(w), 0.0, np.zeros_like(gap)]
    balance = 1.0 / np.maximum(1, np.bincount(grade, minlength=grades))[grade] if n else np.empty(0)
    balance = balance / balance.sum() if n else balance
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1 if n else 1):
        z = np.bincount(row, weights=w[col], minlength=n)
        theta = base + np.concatenate(([0], np.cumsum(np.exp(gap))))  # grades - 1 ordered thresholds
        at = np.concatenate((np.ones((n, 1)), sig(z[:, None] - theta), np.zeros((n, 1))), axis=1)
        i = np.arange(n)
        hi, lo = at[i, grade], at[i, grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        dz = -balance * (hi * (1 - hi) - lo * (1 - lo)) / p
        dt = np.zeros(grades - 1)
        for j in range(grades - 1):
            s = at[:, j + 1] * (1 - at[:, j + 1])
            dt[j] = (balance / p * s * ((grade == j + 1).astype(float) - (grade == j))).sum()
        grads = [np.bincount(col, weights=dz[row], minlength=len(w)) + l2 * w / 10, dt.sum(), np.array([dt[j + 1 :].sum() * np.exp(gap[j]) for j in range(grades - 2)])]
        new = []
        for k, (x, g) in enumerate(zip((w, base, gap), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            new.append(x - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        w, base, gap = new
    return {"buckets": used, "weights": w, "thresholds": base + np.concatenate(([0], np.cumsum(np.exp(gap))))}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most sample labelled documents of each grade, chosen by the hash of their id.

    labels: doc_id, quality, toxic. A row with a null quality and toxic is not used; a null toxic
    counts as 0. Conflicting labels of a document: its least grade. Of rows of one doc_id, one is used. No
    labels: a model without weights.
    """
    on_workers(docs.sparkSession)
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)
    own = labels.select("doc_id", grade.alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    # A first cut by hash, at the scan, keeps what is ranked below small, whatever the table's size: grades have few rows.
    share = {r["grade"]: r["n"] for r in own.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    limit = F.coalesce(*(F.when(F.col("grade") == g, min(1 << 40, (2 * sample << 40) // n)) for g, n in sorted(share.items())), F.lit(0).cast("long"))
    own = own.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).where(F.col("h") < limit)
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("grade").orderBy("h", "doc_id"))).where(f"k <= {sample}")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "set": [features(t).astype("<i4").tobytes() for t in pdf["text"]]})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own.select("doc_id", "grade")), "doc_id")  # at most 3 * sample rows
    got = rows.mapInPandas(run, "doc_id long, grade int, set binary").groupBy("doc_id", "grade").agg(F.min("set").alias("set")).toPandas().sort_values("doc_id")
    return fit([np.frombuffer(x, "<i4").astype(np.int64) for x in got["set"]], got["grade"].to_numpy(np.int64))


def grade_documents(docs: DataFrame, model: dict, least_tail: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, expected_grade, tail, kept, carried) of every row: kept if P(best grade) >= least_tail.

    carried: a struct of the columns named in carry, whatever their names. Null or empty texts are graded by
    their shape. Repeated rows stay, as do rows without a doc_id; other columns are not read. An empty table
    gives an empty result.
    """
    on_workers(docs.sparkSession)
    buckets, values, theta = model["buckets"].astype(np.int32), model["weights"].astype(np.float32), model["thresholds"]
    inner = [f"c{i}" for i in range(len(carry))]

    def run(batches):
        import pyarrow as pa

        w = np.zeros(BUCKETS, np.float32)
        w[buckets] = values
        for b in batches:
            z = np.array([w[features(t)].sum(dtype=np.float64) for t in b.column("text").to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30)))
            columns = [b.column("doc_id"), pa.array(z), pa.array(p.sum(axis=1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= least_tail), *(b.column(c) for c in inner)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "expected_grade", "tail", "kept", *inner])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(i) for c, i in zip(carry, inner, strict=True)])
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, score double, expected_grade double, tail double, kept boolean").fields, *(T.StructField(i, rows.schema[i].dataType) for i in inner)])
    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", "score", "expected_grade", "tail", "kept", F.struct(*[F.col(i).alias(c) for i, c in zip(inner, carry, strict=True)]).alias("carried") if carry else F.lit(None).cast("string").alias("carried"))
