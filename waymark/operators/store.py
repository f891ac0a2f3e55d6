"""Owner-filtered reads, row changes as new DataFrames, and constraint checks.

Parquet tables have no DELETE, so a change returns the table as it is afterwards; the caller
writes it to a new path.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.blocks import BLOCK_ROWS, block_of, ranked

#: Owner column and allowed verbs of each table.
POLICIES = {
    "profiles": ("id", {"select", "update"}),
    "segments": ("user_id", {"select", "insert", "update", "delete"}),
    "badges": ("user_id", {"select", "insert"}),
}


class Refused(Exception):
    """A change that the policies or constraints do not allow."""


@dataclass(frozen=True)
class Secured:
    """A table as one principal sees it."""

    df: DataFrame
    table: str
    principal: object

    def _may(self, verb: str) -> str:
        owner, verbs = POLICIES[self.table]
        if verb not in verbs:
            raise Refused(f"{verb} on {self.table}")
        return owner

    def select(self, *columns: str, row_cap: int | None = None) -> DataFrame:
        """Own rows only; no cap unless asked for."""
        own = self.df.where(F.col(self._may("select")) == F.lit(self.principal))
        own = own.select(*columns) if columns else own
        return own if row_cap is None else own.limit(row_cap)

    def responses(self, order: str, row_cap: int, *columns: str) -> DataFrame:
        """All own rows by a number without ties, and the number from 0 of the capped response that
        brings each: a cap bounds a response, not what a principal gets."""
        own = ranked(self.select(), [POLICIES[self.table][0]], [order], block_of(F.col(order), BLOCK_ROWS), "_place")
        return own.select(*columns, F.floor(F.col("_place") / F.lit(float(row_cap))).alias("response"))

    def insert(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The table with the rows, and the rows as stored (defaults filled in)."""
        owner = self._may("insert")
        if not rows.where(~F.col(owner).eqNullSafe(F.lit(self.principal))).isEmpty():
            raise Refused(f"rows of another owner for {self.table}")
        stored = with_defaults(rows, self.df.schema)
        return self.df.unionByName(stored), stored

    def delete(self, ids: list) -> DataFrame:
        """The table without own rows of these ids; an id that is not there is no error."""
        owner = self._may("delete")
        return self.df.where(~F.coalesce(F.col("id").isin(ids) & (F.col(owner) == F.lit(self.principal)), F.lit(False)))

    def update(self, row_id, **values) -> DataFrame:
        """The table with new values in an own row; a row cannot be given to another owner."""
        owner = self._may("update")
        if values.get(owner, self.principal) != self.principal:
            raise Refused(f"change of {owner} on {self.table}")
        hit = F.coalesce((F.col("id") == F.lit(row_id)) & (F.col(owner) == F.lit(self.principal)), F.lit(False))
        return self.df.withColumns({k: F.when(hit, F.lit(v).cast(self.df.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})


def with_defaults(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the table's columns; a missing id or timestamp is made, anything else is null."""
    made = {"id": F.uuid(), "created_at": F.current_timestamp(), "earned_at": F.current_timestamp()}
    have = set(rows.columns)
    col = lambda f: (F.coalesce(F.col(f.name), made[f.name]) if f.name in have else made[f.name]) if f.name in made else (F.col(f.name) if f.name in have else F.lit(None))
    return rows.select(*[col(f).cast(f.dataType).alias(f.name) for f in schema])


def single(df: DataFrame) -> DataFrame:
    """df if it has exactly one row, else an error."""
    if (n := df.limit(2).count()) != 1:
        raise Refused(f"expected one row, found {'none' if n == 0 else 'more'}")
    return df


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("date_begun").desc_nulls_first(), "id")


def page(df: DataFrame, order: list, number: int, rows: int) -> DataFrame:
    """A page, from 0, of the rows in a total order."""
    return df.orderBy(*order).offset(number * rows).limit(rows)


def username_available(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds available to (candidate): no profile has it, ignoring case and outer blanks. Null is available."""
    taken = profiles.where(F.col("username").isNotNull()).select(F.lower("username").alias("_u")).distinct()
    asked = candidates.withColumn("_u", F.lower(F.trim("candidate")))
    return asked.join(taken.withColumn("_t", F.lit(True)), "_u", "left").withColumn("available", F.col("_t").isNull()).drop("_u", "_t")


def username_of(meta: Column) -> Column:
    """Trimmed username of a metadata document; blank or missing is null."""
    return F.nullif(F.trim(F.get_json_object(meta, "$.username")), F.lit(""))


def profiles_of(users: DataFrame) -> DataFrame:
    """The profile row that each new user gets."""
    return users.select("id", username_of(F.col("raw_user_meta_data")).alias("username"))


def violations(df: DataFrame, unique: list[list[str]] = (), not_null: list[str] = (), references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One row (rule, n) per constraint with the number of offending keys or rows.

    Keys with a null column are not compared, so several nulls are allowed.
    """
    parts = []
    for keys in unique:
        full = df.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1")
        parts.append(full.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unique({','.join(keys)})").alias("rule"), "n"))
    for c in not_null:
        parts.append(df.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"not_null({c})").alias("rule"), "n"))
    for c, (to, key) in (references or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(to.select(F.col(key).alias(c)).distinct(), c, "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"references({c})").alias("rule"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def migrate_dates(df: DataFrame) -> DataFrame:
    """Old segment tables: one date becomes two, and newer columns appear if they are missing."""
    df = df.withColumnRenamed("hiked_date", "date_begun")
    for name, kind in (("date_completed", "date"), ("duration_minutes", "int"), ("states", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
