"""Functions for SQL: a table function of the rungs of posters' ladders, and the rules' defaults.

``register`` makes them known to a session. They do what the DataFrame functions of ``roles`` do, for those who write
SQL; rules are a JSON object of what differs from the defaults.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .roles import RULES, Rules

RUNGS = "poster long, slot int, label int, hex string, share double, level int"
_NAMES = ("poster", "slot", "label", "hex", "share", "level")
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())


def _limit(p: dict, q: dict, how: Rules) -> int:
    """The number of limits that two colours don't keep, from the strictest on."""
    d = sum((p[c] - q[c]) ** 2 for c in ("ll", "la", "lb")) ** 0.5
    turn = abs((p["hue"] - q["hue"] + 180) % 360 - 180)
    least = how.hue_gap if min(p["chroma"], q["chroma"]) >= how.hue_chroma and turn < how.hue else how.gap
    return sum(d < max(least, how.gap) * s for s in how.relaxed)


def rungs(clusters: list[dict], how: Rules) -> list[tuple]:
    """The ladder of one poster from its at most 16 clusters, as RUNGS."""
    pool = [c for c in clusters if c["share"] >= how.least_share] or clusters
    taken: list[dict] = []
    out = []
    for weight in how.slots:
        ranked = [(-max((_limit(c, t, how) for t in taken), default=0), weight * c["dominance"] + (1 - weight) * c["vividness"], c["share"], c["hex"], i) for i, c in enumerate(pool) if c not in taken]
        if not ranked or (max(ranked)[0] == -len(how.relaxed) and len(taken) >= how.filled):
            break
        level, *_, at = max(ranked)
        taken.append(pool[at])
        out.append((pool[at]["poster"], len(taken), pool[at]["label"], pool[at]["hex"], pool[at]["share"], -level))
    return out


@F.arrow_udtf(returnType=RUNGS)
class LadderRows:
    """``ladder_rows(TABLE(t) PARTITION BY (poster), rules)``: RUNGS of posters' clusters (poster, label, hex, ll, la, lb,
    chroma, hue, share, dominance, vividness), as ``roles.described`` gives them. A poster is a partition."""

    def __init__(self):
        self.rows: list[dict] = []
        self.how: Rules | None = None

    def eval(self, clusters: pa.RecordBatch, rules: pa.Array) -> Iterator[pa.Table]:
        self.rows += clusters.to_pylist()
        if self.how is None and len(rules):
            self.how = Rules.from_json(rules[0].as_py())
        yield pa.Table.from_arrays([pa.array([], t) for t in _KINDS], list(_NAMES))

    def terminate(self) -> Iterator[pa.Table]:
        found = rungs(self.rows, self.how or RULES)
        yield pa.Table.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(_KINDS)], list(_NAMES))


def register(spark: SparkSession) -> None:
    """``ladder_rows`` and ``role_rules()``, the defaults as JSON, for this session's SQL."""
    spark.udtf.register("ladder_rows", LadderRows)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION role_rules() RETURNS STRING RETURN '{json.dumps(asdict(RULES))}'")


def ladder_rows(described: DataFrame, rules: str = "{}") -> DataFrame:
    """``ladder_rows`` by SQL over clusters."""
    spark = described.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM ladder_rows(TABLE(SELECT * FROM {clusters}) PARTITION BY (poster), :rules)", args={"rules": rules}, clusters=described)
