"""Similarity of contexts and candidate pairs, worked out in blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .contexts import active_spans, ruled_out
from .prefix import ACTIVE_WINDOW_US, time_bucket

SIDE = 1024    # contexts, and spans of pairs, in a block
AT_ONCE = 128  # contexts of a block looked at together
_SCHEMA = "metadata_id long, cand_user long, cand_site long, score double"


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    flat = table[name].combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _scored(kind: str, at_once: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(contexts: pa.Table, pairs: pa.Table) -> pa.Table:
        """A row for each context of a block and pair that is open at its time, products summed up in order of dimensions."""
        out = {"metadata_id": [], "cand_user": [], "cand_site": [], "score": []}
        if contexts.num_rows and pairs.num_rows:
            col = lambda t, c: t[c].to_numpy()
            who, us, a, norm_a = col(contexts, "metadata_id"), col(contexts, "us"), _vectors(contexts, "_va"), col(contexts, "_la")
            user, site, b, norm_b = col(pairs, "user_id"), col(pairs, "site_id"), _vectors(pairs, "_vb"), col(pairs, "_lb")
            start, end = col(pairs, "start_us")[:, None], col(pairs, "end_us")[:, None]
            users, own = np.unique(user, return_inverse=True)
            barred = contexts["_barred"].to_pylist()
            for first in range(0, len(who), at_once):
                part = slice(first, first + at_once)
                closed = np.zeros((len(users), len(us[part])), bool)
                for i, gone in enumerate(barred[part]):
                    if gone:
                        at = np.minimum(np.searchsorted(users, gone), len(users) - 1)
                        closed[at[users[at] == gone], i] = True
                pair, ctx = np.nonzero((start < us[part]) & (us[part] <= end) & ~closed[own])
                total = np.zeros((len(user), len(us[part])))
                for x, y in zip(a[part].T, b.T):
                    total += y[:, None] * x if kind == "cosine" else np.square(x - y[:, None])
                if kind == "cosine":
                    norm = norm_a[part][ctx] * norm_b[pair]
                    value = np.divide(total[pair, ctx], norm, out=np.zeros(len(pair)), where=norm > 0)
                else:
                    value = -np.sqrt(total[pair, ctx])
                for c, v in (("metadata_id", who[part][ctx]), ("cand_user", user[pair]), ("cand_site", site[pair]), ("score", value)):
                    out[c].append(v)
        none = {"score": np.zeros(0)}
        return pa.table({c: np.concatenate(v) if v else none.get(c, np.zeros(0, np.int64)) for c, v in out.items()})
    return score


def candidate_similarity(ctx: DataFrame, of_pair: DataFrame, usps: DataFrame, activity: DataFrame, edge: DataFrame, kind: str = "cosine",
                         side: int = SIDE, at_once: int = AT_ONCE, window_us: int = ACTIVE_WINDOW_US) -> DataFrame:
    """(metadata_id, cand_user, cand_site, score) of all candidates of contexts, as ``scoring.similarity`` of their rows.

    Contexts have a vector of doubles and its norm (_va, _la), pairs too (user_id, site_id, _vb, _lb). Both meet in blocks of a
    window's length in time; a context brings the users of the block that are ruled out for it. Candidates pass no exchange.
    """
    c = ctx.select("metadata_id", "us", "_va", "_la", time_bucket("us", window_us).alias("span"))
    spans = cut_lineage(active_spans(usps, activity, window_us).select("user_id", "site_id", "start_us", "end_us").join(of_pair, ["user_id", "site_id"]))
    days = c.select("span").distinct()
    held = spans.withColumn("span", F.explode(F.sequence(time_bucket("start_us", window_us), time_bucket("end_us", window_us)))).join(F.broadcast(days), "span")
    n = lambda df, name: df.groupBy("span").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias(name))
    shape = cut_lineage(n(c, "_rows").join(n(held, "_cols"), "span"))  # one row a span
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = lambda key, k: F.pmod(F.xxhash64(key), F.col(k)).cast("int")
    out = (ruled_out(ctx, usps, edge).withColumn("span", time_bucket("us", window_us)).join(shape, "span").withColumn("_col", own("cand_user", "_cols"))
           .groupBy("metadata_id", "_col").agg(F.collect_list("cand_user").alias("_barred")))
    left = (c.join(F.broadcast(shape), "span").withColumn("_row", own("metadata_id", "_rows")).withColumn("_col", each("_cols")).drop("_rows", "_cols")
            .join(out, ["metadata_id", "_col"], "left"))
    right = held.join(F.broadcast(shape), "span").withColumn("_col", own("user_id", "_cols")).withColumn("_row", each("_rows")).drop("_rows", "_cols")
    block = ["span", "_row", "_col"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_scored(kind, at_once), _SCHEMA)
