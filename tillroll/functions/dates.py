"""Calendar-month arithmetic on integer month numbers (year * 12 + month - 1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_label(number: Column) -> Column:
    """``yyyy-MM`` of a month number."""
    first_day = F.make_date(
        F.call_function("div", number, F.lit(12)).cast("int"),
        (F.pmod(number, F.lit(12)) + 1).cast("int"),
        F.lit(1),
    )
    return F.date_format(first_day, "yyyy-MM")


_WORD = 64


@dataclass(frozen=True)
class MonthMask:
    """Sets of months between two month numbers, a bit each, in longs of 64 months."""

    first: int
    last: int

    @property
    def columns(self) -> list[str]:
        return [f"w{w}" for w in range((self.last - self.first) // _WORD + 1)]

    def _place(self, month: Column) -> tuple[Column, Column]:
        at = month - F.lit(self.first)
        return F.floor(at / _WORD), (at % _WORD).cast("int")

    def aggregates(self, month: Column) -> list[Column]:
        """``cohort_no`` and ``until``, the least and the latest month, and the mask: buffers
        of fixed size, so a hash aggregate."""
        word, bit = self._place(month)
        held = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
        masks = [
            F.coalesce(F.bit_or(F.when(word == w, held)), F.lit(0)).alias(c) for w, c in enumerate(self.columns)
        ]
        return [F.min(month).alias("cohort_no"), F.max(month).alias("until"), *masks]

    def spread(self, masks: DataFrame) -> DataFrame:
        """A row (cohort_no, month_no) for every month of every mask."""
        rows = masks.where("cohort_no is not null").select(
            "cohort_no", *self.columns, F.explode(F.sequence("cohort_no", "until")).alias("month_no")
        )
        word, bit = self._place(F.col("month_no"))
        mask = F.col("w0")
        for w, column in enumerate(self.columns[1:], 1):
            mask = F.when(word == w, F.col(column)).otherwise(mask)
        return rows.where(F.getbit(mask, bit) == 1).select("cohort_no", "month_no")
