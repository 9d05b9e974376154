"""Pinned schemas, and the check that a frame has one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class Schema(str):
    """A schema as DDL text, which needs no session until it is used."""

    __slots__ = ()

    @property
    def struct(self) -> StructType:
        return StructType.fromDDL(self)

    @property
    def names(self) -> list[str]:
        return self.struct.fieldNames()

    def plus(self, ddl: str) -> Schema:
        return Schema(f"{self}, {ddl}")


TICKS = Schema("pair string, ts timestamp, bid double, ask double, bid_volume double, ask_volume double, source string")
QUOTES = ("bid", "ask", "mid")
STEPS = ("open", "high", "low", "close")
BARS = Schema("pair string, ts timestamp, " + ", ".join(f"{q}_{s} double" for q in QUOTES for s in STEPS) + ", tick_count bigint, spread_mean double, spread_max double")
PROBES = Schema("pair string, date string, hour smallint, kind string, status int, compressed_bytes bigint, ticks bigint, attempts smallint, stage string, detail string")
LEDGER = Schema(
    "record string, experiment_id string, taskcard string, config_sha256 string, code_commit string, seed bigint, mode string, rerun_class string, "
    "started_at string, ended_at string, status string, result_files array<string>, result_hash string, scored boolean, note string, malformed string"
)
MANIFEST_HOURS = Schema(
    "pair string, date date, hour int, status string, decoded_ticks bigint, written_ticks bigint, duplicates_dropped bigint, sha256 string, compressed_bytes bigint, decoded_bytes bigint, "
    "origin string, path string, first_ts timestamp, last_ts timestamp, spread_pips struct<median_pips:double,mean_pips:double,p99_pips:double,p99_9_pips:double,max_pips:double>, "
    "issues array<struct<reason:string,detail:string,count:bigint>>"
)


class SchemaError(ValueError):
    """A frame has not the columns and types that it must have."""


def require(df: DataFrame, schema: Schema, exact: bool = True) -> DataFrame:
    """``df`` with the schema's columns in its order, or an error that names every difference."""
    have = dict(df.dtypes)
    wrong = [f"{f.name}: {have.get(f.name, 'absent')}, not {f.dataType.simpleString()}" for f in schema.struct if have.get(f.name) != f.dataType.simpleString()]
    wrong += [f"{c}: not in the schema" for c in have if exact and c not in schema.names]
    if wrong:
        raise SchemaError("; ".join(wrong))
    return df.select(*schema.names)
