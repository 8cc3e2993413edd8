"""Which column plays which part, and the levels of the experimental design."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Roles:
    """Column roles of a profile table plus the levels the design allows.

    ``days``, ``bioreps`` and ``concentrations`` are the levels the analysis runs over; they bound
    the number of strata when a plan is built, which is what makes a broadcast of per-stratum
    statistics safe.
    """

    day: str = "Metadata_Day"
    biorep: str = "Metadata_Biorep"
    well: str = "Metadata_Well"
    tech_rep: str = "Tech_replica"
    conc: str = "Concentration"
    well_key: str = "Day_Well_BR"
    cell: str = "cell_ID"
    counts: tuple[str, ...] = (
        "counts_Cells",
        "counts_Cytoplasm",
        "counts_FilteredNuclei",
        "counts_RelateLysoCell",
        "counts_RelateMitoCell",
    )
    # After standardization only these counts are still metadata; the other two are features.
    downstream_counts: tuple[str, ...] = ("counts_Cells", "counts_Cytoplasm", "counts_FilteredNuclei")
    days: tuple[str, ...] = ("D1", "D5", "D7", "D9")
    bioreps: tuple[str, ...] = ("BR1", "BR2", "BR3", "BR4")
    concentrations: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
    control: int = 11
    # Bioreps that exist on a day; a day that is not listed has all of them.
    day_bioreps: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.conc, self.well, self.day, self.biorep, self.tech_rep, self.well_key, self.cell)

    def metadata(self, df: DataFrame, downstream: bool = False) -> list[str]:
        """Metadata columns present in ``df``, in table order."""
        counts = self.downstream_counts if downstream else self.counts
        known = set(self.keys) | set(counts)
        return [c for c in df.columns if c in known]

    def features(self, df: DataFrame, downstream: bool = False) -> list[str]:
        """Numeric columns that are not metadata, in table order."""
        known = set(self.metadata(df, downstream))
        return [c for c in numeric_columns(df) if c not in known]

    def bioreps_of(self, day: str) -> tuple[str, ...]:
        return self.day_bioreps.get(day, self.bioreps)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGRAL + _FLOATING)]


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATING)]
