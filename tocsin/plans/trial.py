"""The trial's result graph as lazily built DataFrames.

``Trial`` holds the inputs (series, forms, literal dimensions) and exposes
every outcome, unit list and summary as a method returning a DataFrame.  No
method collects: the caller decides what to write or show.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.operators import cohort, outcomes
from tocsin.operators.episodes import DAY_SECONDS, episodes
from tocsin.operators.rows import distinct_units, first_row_per_key
from tocsin.functions.alarm import any_alarm_state, event_accepted
from tocsin.sources import fixtures, literals

# Fixed value for the fixture: the first patient of the exclusion list is kept
# (the trial keeps one patient whose sedation dose is missing).
FIXTURE_OVERRIDES = ("E007",)

# The fixture ticks once an hour: thirty days are 720 rows.
FIXTURE_CHUNK_SECONDS = 30 * DAY_SECONDS

# Columns of the patient sheet and their types.
PATIENT_COLUMNS = ("patient", "age", "sex", "totalMidaz", "totalFent", "totalOtherSedation", "oxygenDevice",
                   "procedure", "caseStart", "caseEnd")
PATIENT_TYPES = {"age": "double", "totalMidaz": "double", "totalFent": "double"}


@dataclass
class Trial:
    spark: SparkSession
    series_fn: Callable[[], DataFrame]
    patient_form_fn: Callable[[], DataFrame]
    adverse_form_fn: Callable[[], DataFrame]
    nurse_sheet_fn: Callable[[], DataFrame]
    overrides: Sequence[str] = FIXTURE_OVERRIDES
    missing_rows: Sequence[tuple] = literals.MISSING_UNITS
    allocation_rows: Sequence[tuple] = literals.ALLOCATION
    chunk_seconds: int = DAY_SECONDS
    scope: str = "series"
    flags: Sequence[str] | None = None
    _cache: dict = field(default_factory=dict)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Trial":
        return cls(
            spark=spark,
            series_fn=lambda: fixtures.series(spark, sf_dir),
            patient_form_fn=lambda: fixtures.patient_form(spark, sf_dir),
            adverse_form_fn=lambda: fixtures.adverse_form(spark, sf_dir),
            nurse_sheet_fn=lambda: fixtures.nurse_sheet(spark, sf_dir),
            **({"chunk_seconds": FIXTURE_CHUNK_SECONDS} | kw),
        )

    @classmethod
    def from_folders(cls, spark: SparkSession, series_path: str, workbook_dir: str, **kw) -> "Trial":
        """Real inputs: the ingested series dataset (O04) and the observer
        workbooks (O02) for the patient and adverse-event sheets."""
        from tocsin.session import materialize
        from tocsin.sources.dataset import read_series
        from tocsin.sources.workbook import read_workbooks, sheet_frame, sheet_header

        # The fixture's defaults hold for the fixture only: no patient is kept
        # and no unit is added unless the caller names them.
        kw.setdefault("overrides", ())
        kw.setdefault("missing_rows", ())
        cells = materialize(read_workbooks(spark, workbook_dir), "workbook-cells")  # one parse for all sheets

        def patient_form() -> DataFrame:
            return sheet_frame(cells, PATIENT_COLUMNS, sheet="Patient", types=PATIENT_TYPES).drop("id", "row")

        def adverse_form() -> DataFrame:
            names = sheet_header(cells, "Adverse events")
            return sheet_frame(cells, names, sheet="Adverse events").drop("row")

        return cls(spark=spark, series_fn=lambda: read_series(spark, series_path),
                   patient_form_fn=patient_form, adverse_form_fn=adverse_form,
                   nurse_sheet_fn=lambda: sheet_frame(cells, ["nurse", "time"], sheet="Nurse ID"), **kw)

    def _memo(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        # DataFrames are immutable plans: build each input once per Trial.
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    # -- inputs -----------------------------------------------------------
    def series(self) -> DataFrame:
        return self._memo("series", self.series_fn)

    def patient_form(self) -> DataFrame:
        return self._memo("patient_form", self.patient_form_fn)

    def allocation(self) -> DataFrame:
        return self._memo("allocation", lambda: literals.allocation(self.spark, self.allocation_rows))

    def missing(self) -> DataFrame:
        return self._memo("missing", lambda: literals.missing_units(self.spark, self.missing_rows))

    # -- cohort -----------------------------------------------------------
    def excluded(self) -> DataFrame:
        return self._memo("excluded", lambda: cohort.exclusions(self.patient_form(), self.overrides))

    def analysed(self) -> DataFrame:
        return self._memo("analysed", lambda: cohort.analysed_series(self.series(), self.excluded()))

    def units(self) -> DataFrame:
        return cohort.analysed_series(distinct_units(self.series()), self.excluded())

    # -- episodes and outcomes -------------------------------------------
    def state(self) -> DataFrame:
        return outcomes.with_state(self.series(), self.flags)

    def episodes(self, end: str = "clear", scope: str | None = None) -> DataFrame:
        state = any_alarm_state(self.flags) if self.flags else any_alarm_state()
        answered = event_accepted(F.col("event"), "any") if end == "answered" else None
        return episodes(self.analysed(), state, answered, end=end, scope=scope or self.scope,
                        chunk_seconds=self.chunk_seconds)

    # Outcomes come unordered; the output order (O25) is the sink's business.
    def primary(self, scope: str | None = None) -> DataFrame:
        return outcomes.seconds_in_alarm(
            self.series(), None, self.missing(), end="answered", scope=scope or self.scope,
            chunk_seconds=self.chunk_seconds, flags=self.flags, excluded=self.excluded())

    def alarm_duration(self, scope: str | None = None, with_missing: bool = True) -> DataFrame:
        return outcomes.seconds_in_alarm(
            self.series(), None, self.missing() if with_missing else None, end="clear", scope=scope or self.scope,
            chunk_seconds=self.chunk_seconds, flags=self.flags, excluded=self.excluded())

    def alarms(self, vocabulary: str) -> DataFrame:
        return outcomes.event_alarm_count(self.series(), self.missing(), vocabulary, self.flags, self.excluded())

    def desaturation(self, sample: str = "episode_end", columns: Sequence[str] = ()) -> DataFrame:
        return outcomes.desaturation_area(self.series(), None, sample=sample, scope=self.scope,
                                          chunk_seconds=self.chunk_seconds, flags=self.flags,
                                          excluded=self.excluded(), columns=columns)

    def adverse(self) -> DataFrame:
        return cohort.adverse_flags(self.adverse_form_fn(), self.units())

    def cluster_sizes(self, analysed: bool) -> DataFrame:
        return cohort.cluster_sizes(self.series(), self.missing(), self.excluded() if analysed else None)

    def first_rows(self) -> DataFrame:
        s = self.series()
        return first_row_per_key(s, ["id"], "datetime", ["datetime", "nurse", "randomization"])

    def nurse_units(self) -> DataFrame:
        # All nurses of the observers' sheets, those without patients included.
        nurses = cohort.nurse_dimension(self.nurse_sheet_fn().select("nurse"), self.allocation())
        return cohort.units_with_nurses(self.series(), nurses, self.missing())

    def form_units(self) -> DataFrame:
        return cohort.form_with_units(self.patient_form(), self.nurse_units(), self.excluded())
