"""Incremental consolidation: what each landed batch adds to the ledger, kept as mergeable parts.

For every batch (``epoch``) these tables are written once, each from the batch's rows alone:

* ``values``: its distinct texts per column, parsed and counted (``profile.value_counts``);
* ``dated`` and ``undated``: its cleaned rows with and without a date of their own, duplicates out;
* ``first``: its first valid date in row order (one row);
* ``months``: the monthly sums and counts of its dated rows (``shared.monthly_table``);
* ``decision``: the column names, roles and optional columns that hold with it (one row).

Sums add up, counts of texts add up, the first of first dates is the first. So a new batch is
cleaned alone, and cards come from the merged months plus one pass over the undated rows.

Only when the batch changes the decision - a column's standard name, a role or an optional column -
must earlier rows be cleaned again: that is one full pass over all landed batches. A late file
that changes the first valid date needs none, as rows keep the date they came with.

A row without a date that gets the first valid date may then equal a row that has it: such
duplicates are found among the rows of that date only.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.functions import columns as X
from ledgerkit.functions.naming import standard_names
from ledgerkit.operators.clean import clean_values, dedupe, named_rows
from ledgerkit.operators.prepare import ColumnMapping, Prepared, choose_optional, prepare, role_columns
from ledgerkit.operators.profile import merged_counts, profile_of, value_counts
from ledgerkit.operators.roles import resolve_roles, role_candidates
from ledgerkit.plans import profiles as P
from ledgerkit.plans.shared import build_shared, merged_months, monthly_table

EPOCH = "_lk_epoch"
ORDER = ("source_file", "_lk_block", "_lk_line")
INTERNAL = ORDER[1:]
DAY = "_lk_day"
DIMS = ("region_label",)
NO_DATE = _dt.date(1970, 1, 1)  # stands for "today" where no row without a date is looked at


@dataclass(frozen=True)
class Decision:
    """What the rows of all batches so far decide about a column's name and use."""

    columns: tuple[str, ...]           # landed columns in order of arrival
    mapping: ColumnMapping
    defaults: dict[str, str]           # role -> column that no file has
    optional: dict[str, str]           # concept -> column

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def changes(self, earlier: "Decision") -> bool:
        """Whether rows cleaned under ``earlier`` must be cleaned again."""
        names = dict(zip(self.columns, standard_names(self.columns)))
        renamed = any(names[c] != n for c, n in zip(earlier.columns, standard_names(earlier.columns)))
        return renamed or (self.mapping, self.defaults, self.optional) != (earlier.mapping, earlier.defaults, earlier.optional)


def decision_of(text: str) -> Decision:
    d = json.loads(text)
    return Decision(tuple(d["columns"]), ColumnMapping(**d["mapping"]), d["defaults"], d["optional"])


class LedgerState:
    """The parts of a ledger under ``root``. ``landed`` holds the raw rows (``folder_stream``)."""

    def __init__(self, spark: SparkSession, landed: str, root: str, dims: Sequence[str] = DIMS):
        self.spark, self.landed, self.root, self.dims = spark, landed.rstrip("/"), root.rstrip("/"), tuple(dims)

    # ------------------------------------------------------------------ tables
    def _write(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/{EPOCH}={epoch}")

    def _read(self, table: str, epochs: Sequence[int]) -> DataFrame:
        paths = [f"{self.root}/{table}/{EPOCH}={e}" for e in epochs]
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def epochs(self) -> list[int]:
        """The batches whose parts are complete: their decision is written last."""
        return self._numbers(f"{self.root}/decision")

    def _numbers(self, folder: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{EPOCH}="))

    def decision(self, epoch: int) -> Decision:
        return decision_of(self._read("decision", [epoch]).first()["text"])

    # ------------------------------------------------------------------ one batch
    def _raw(self, epoch: int, columns: Sequence[str]) -> DataFrame:
        """The landed rows of a batch with all ``columns`` of the ledger under standard names."""
        raw = self.spark.read.parquet(f"{self.landed}/{EPOCH}={epoch}")
        here = [F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return named_rows(raw.select(*INTERNAL, *here), INTERNAL)

    def _decide(self, epoch: int, earlier: Sequence[int], columns: tuple[str, ...]) -> Decision:
        rows = self._raw(epoch, columns)
        candidates = role_candidates(rows.columns, internal=INTERNAL)
        self._write(value_counts(rows, candidates), "values", epoch)
        profile = profile_of(merged_counts(self._read("values", [*earlier, epoch])))
        share = {r["column_name"]: r["numeric_ratio"] for r in profile.collect()}  # one row per column
        roles = resolve_roles(rows, (), internal=INTERNAL, profile=profile)
        free = [c for c in [*rows.columns, *roles.defaults.values()] if c not in INTERNAL and c not in role_columns(roles.mapping)]
        optional = choose_optional(free, lambda wanted: {c: share.get(c) or 0.0 for c in wanted})
        return Decision(columns, roles.mapping, roles.defaults, optional)

    def _clean(self, epoch: int, d: Decision) -> None:
        """The parts of one batch under a decision."""
        m = d.mapping
        rows = clean_values(self._raw(epoch, d.columns), m, d.defaults, NO_DATE)
        day = F.lit(None).cast("date") if "date" in d.defaults else X.parse_date(F.col(m.date))
        rows = rows.withColumn(DAY, day).withColumn(m.date, F.date_format(day, "yyyy-MM-dd"))
        # a file lies in one batch and its name tells rows apart: duplicates never cross batches
        rows = dedupe(rows, INTERNAL)
        for table, kept in (("dated", F.col(DAY).isNotNull()), ("undated", F.col(DAY).isNull())):
            self._write(rows.where(kept), table, epoch)
        dated = self._read("dated", [epoch])
        self._write(dated.agg(F.min(F.struct(*ORDER, DAY)).alias("first")).select("first.*"), "first", epoch)
        self._write(monthly_table(self._prepared(dated, d, NO_DATE, self.dims), first_dates=False), "months", epoch)

    def add(self, epoch: int) -> bool:
        """Take a landed batch in; True if it changed the decision (a full pass). A batch may be
        added again after a failure: its parts are overwritten."""
        earlier = [e for e in self.epochs() if e < epoch]
        before = self.decision(earlier[-1]) if earlier else None
        new = [c for c in self.spark.read.parquet(f"{self.landed}/{EPOCH}={epoch}").columns if c not in INTERNAL]
        known = before.columns if before else ()
        columns = (*known, *[c for c in new if c not in known])
        decision = self._decide(epoch, earlier, columns)
        renamed = before is not None and standard_names(columns)[: len(known)] != standard_names(known)
        if renamed:  # the texts were counted under other names
            for e in earlier:
                rows = self._raw(e, columns)
                self._write(value_counts(rows, role_candidates(rows.columns, internal=INTERNAL)), "values", e)
            decision = self._decide(epoch, earlier, columns)
        again = before is not None and decision.changes(before)
        for e in (*earlier, epoch) if again else (epoch,):
            self._clean(e, decision)
        self._write(self.spark.createDataFrame([(decision.text(),)], "text string"), "decision", epoch)
        return again

    # ------------------------------------------------------------------ the whole ledger
    def _prepared(self, rows: DataFrame, d: Decision, as_of: _dt.date, by: Sequence[str]) -> Prepared:
        return prepare(rows, d.mapping, ORDER, as_of, tuple(by), optional=d.optional)

    def _filled(self, epochs: Sequence[int], d: Decision, as_of: _dt.date) -> tuple[DataFrame, Column]:
        """The undated rows with the first valid date (else ``as_of``), and that date."""
        first = self._read("first", epochs).where(F.col(DAY).isNotNull()).orderBy(*ORDER).first()
        day = F.lit(first[DAY] if first else as_of).cast("date")
        return self._read("undated", epochs).withColumns({d.mapping.date: F.date_format(day, "yyyy-MM-dd"), DAY: day}), day

    def ledger(self, as_of: _dt.date) -> DataFrame:
        """The cleaned rows of all batches, as ``folder_stream.clean_ledger`` gives them."""
        epochs = self.epochs()
        filled, day = self._filled(epochs, self.decision(epochs[-1]), as_of)
        dated = self._read("dated", epochs)
        # only rows of the filled date can be equal to a filled row
        that_day = dedupe(dated.where(F.col(DAY) == day).unionByName(filled, allowMissingColumns=True), INTERNAL)
        return dated.where(F.col(DAY) != day).unionByName(that_day, allowMissingColumns=True).drop(DAY)

    def _added(self, epochs: Sequence[int], filled: DataFrame, day: Column) -> DataFrame:
        """The filled rows that equal no dated row of their file."""
        data = [c for c in filled.columns if c not in INTERNAL]
        same_day = self._read("dated", epochs).where(F.col(DAY) == day).select(*[F.col(f"`{c}`").alias(f"_o_{c}") for c in data])
        return filled.join(same_day, [filled[f"`{c}`"].eqNullSafe(same_day[f"`_o_{c}`"]) for c in data], "left_anti")

    def cards(self, as_of: _dt.date, by: Sequence[str] = (), profiles: Sequence[str] = K.MONTHLY_PROFILES) -> DataFrame:
        """Cards of the profiles that need monthly sums only, from the merged months."""
        epochs = self.epochs()
        d = self.decision(epochs[-1])
        filled, day = self._filled(epochs, d, as_of)
        added = self._added(epochs, filled, day)
        extra = monthly_table(self._prepared(added, d, as_of, self.dims), first_dates=False)
        parts = self._read("months", epochs).unionByName(extra, allowMissingColumns=True)
        # these profiles read the merged months only: no row of the ledger is looked at
        p = self._prepared(added, d, as_of, by)
        shared = build_shared(p, raw_monthly=merged_months(parts, p))
        out = [P.build_profile(shared, f)["cards"] for f in profiles]
        for more in out[1:]:
            out[0] = out[0].unionByName(more)
        return out[0]
