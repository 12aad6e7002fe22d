"""URL filters: rules by host suffix and path prefix, then logistic regression on hashed character n-grams.

The model has 2**16 weights over the 3- to 5-grams of ``^host$`` (less its top-level domain) and of ``/path`` (each kind hashed with its own
seed), trained on the driver from a small labelled URL table (a file beside this module, or the caller's) of at most
TRAIN_MAX rows.  The weights (256 kB) are the only thing sent to the workers; scoring is one pass over the URLs in Arrow
batches, nothing shuffled.

Edge cases: a NULL URL, or one without ``://``, has an empty host and path, and is allowed by the model; ids of any type,
NULL among them, stay as they are; a very long URL is scored whole; rows that repeat get equal results; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import beside

BUCKETS, TRAIN_MAX, GRAMS = 1 << 16, 20_000, (3, 4, 5)
#: (verdict, host, path prefix) of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def features(host: str, path: str) -> np.ndarray:
    """Bucket numbers of a URL's n-grams; the top-level domain is left out, which tells little and would decide for hosts
    of few letters."""
    out = []
    for seed, s in ((17, f"^{host.rpartition('.')[0] or host}$"), (91, path)):
        b = np.frombuffer(s.encode("utf-8", "replace"), "u1").astype("u8")
        for n in GRAMS:
            if len(b) >= n:
                h = np.full(len(b) - n + 1, seed * n, "u8")
                for i in range(n):
                    h = (h * np.uint64(0x100000001B3)) ^ b[i : len(b) - n + 1 + i]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                out.append((h >> np.uint64(48)).astype("i8") % BUCKETS)
    return np.concatenate(out) if out else np.empty(0, "i8")


def train(table: Sequence[tuple[str, int]], epochs: int = 30, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from (url, blocked) rows, by AdaGrad on the log loss in a fixed order."""
    rows = [(np.unique(features(*parts(u))), y) for u, y in table[:TRAIN_MAX]]
    w, g, b, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), 0.0, 1e-2
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, y = rows[i]
            scale = 1.0 / np.sqrt(max(1, len(f)))
            e = 1.0 / (1.0 + np.exp(-(b + scale * w[f].sum()))) - y
            d = e * scale + l2 * w[f]
            g[f] += d * d
            w[f] -= rate * d / np.sqrt(g[f])
            gb += e * e
            b -= rate * e / np.sqrt(gb)
    return w, float(b)


def score(w: np.ndarray, b: float, host: str, path: str) -> float:
    f = np.unique(features(host, path))
    return b + float(w[f].sum()) / np.sqrt(max(1, len(f)))


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(_FOLD), m[2]) if m else ("", "")


_FOLD = str.maketrans(_UPPER, _LOWER)
#: The labelled table: lines of 1 (unwanted) or 0, a tab and a URL.
TABLE = Path(__file__).parent / "data" / "labelled_urls.tsv"


def labelled_urls(path: Path = TABLE) -> list[tuple[str, int]]:
    """(url, unwanted) of a labelled table."""
    return [(url, int(label)) for label, url in (line.split("\t", 1) for line in path.read_text("utf-8").splitlines() if line)]


def judge(pages: DataFrame, rules=RULES, table: Sequence[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, score, verdict).  The longest fitting rule decides (host, then path length; ties: the
    earlier), else the model: blocked at a score above 0."""
    w, b = train(table if table is not None else labelled_urls())
    w = w.astype("f4")
    sent = pages.sparkSession.sparkContext.broadcast(w)
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]) - len(rules[i][2]), i))

    def run(urls: list[str | None]) -> list[list]:
        weights, out = sent.value, []
        for url in urls:
            host, path = parts(url)
            hit = next((rules[i] for i in order if (host == rules[i][1] or host.endswith("." + rules[i][1])) and path.startswith(rules[i][2])), None)
            s = float(score(weights, b, host, path)) if host else min(b, 0.0)
            out.append((host, path, hit and hit[1] + hit[2], s, hit[0] if hit else "block" if s > 0 else "allow"))
        return [list(x) for x in zip(*out)]

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    return beside(rows, ["_id"], ["_url"], "host string, path string, rule string, score double, verdict string", run).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
