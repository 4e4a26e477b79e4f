"""Window vocabulary for features.

A feature is a function of a ``Frame``. The frame hands out window expressions
and records which columns and how many earlier or later rows they need; the
registry uses the record to order the features and to size the block overlap.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, Window as W, functions as F

from .scalar import c, fdiv

EWM_TOLERANCE = 1e-15
MAX_EXPONENT = 600.0
POOLED = re.compile(r"\b_w\d+_\b")


class Frame:
    def __init__(self, keys=("symbol", "blk"), order=("pos",), start: Column | None = None, rows: int = 0):
        self.keys = list(keys)
        self.w = W.partitionBy(*keys).orderBy(*order)
        self.start = start if start is not None else F.lit(0).cast("long")
        self.rows = rows
        self.back = 0
        self.ahead = 0
        self.deps: set[str] = set()
        self._specs: dict = {}
        self.pool: dict[str, tuple[str, Column]] = {}
        self.steps: dict[str, tuple[int, int, int]] = {}  # step, rows back, rows ahead
        self.ranks: dict[tuple, tuple[str, Column, int]] = {}  # name, value, rows

    # -- bookkeeping -----------------------------------------------------
    def __getitem__(self, name: str) -> Column:
        self.deps.add(name)
        return F.col(name)

    def x(self, value) -> Column:
        return self[value] if isinstance(value, str) else c(value)

    def need(self, back: int = 0, ahead: int = 0):
        self.back = max(self.back, back)
        self.ahead = max(self.ahead, ahead)

    def rng(self, lo: int, hi: int = 0):
        """Rows frame from lo to hi relative to the current row."""
        self.need(max(0, -lo), max(0, hi))
        if (lo, hi) not in self._specs:
            self._specs[lo, hi] = self.w.rowsBetween(lo, hi)
        return self._specs[lo, hi]

    def once(self, window_column: Column, back: int = 0, ahead: int = 0) -> Column:
        """Name a window expression: equal ones are computed once per layer, however often
        a formula repeats them. A window over another one is computed a step later, and
        its need of rows adds up."""
        key = str(window_column)
        if key not in self.pool:
            inner = [self.steps[n] for n in set(POOLED.findall(key))]
            step = tuple(max([s[i] for s in inner], default=0) + v for i, v in enumerate((1, back, ahead)))
            name = f"_w{len(self.pool)}_"
            self.pool[key], self.steps[name] = (name, window_column), step
            self.need(step[1], step[2])
        return F.col(self.pool[key][0])

    def pooled(self) -> list[list[Column]]:
        """The named window expressions, grouped by step."""
        groups: dict[int, list[Column]] = {}
        for name, column in self.pool.values():
            groups.setdefault(self.steps[name][0], []).append(column.alias(name))
        return [groups[k] for k in sorted(groups)]

    def over(self, agg: Column, lo: int, hi: int = 0) -> Column:
        """Aggregate over a rows frame, whatever the number of values in it."""
        return self.once(agg.over(self.rng(lo, hi)), max(0, -lo), max(0, hi))

    # -- offsets ---------------------------------------------------------
    def lag(self, value, n: int = 1, default=None) -> Column:
        return self.once(F.lag(self.x(value), n, default).over(self.w), back=n)

    def lead(self, value, n: int = 1) -> Column:
        return self.once(F.lead(self.x(value), n).over(self.w), ahead=n)

    def diff(self, value, n: int = 1) -> Column:
        return self.x(value) - self.lag(value, n)

    def pct(self, value, n: int = 1) -> Column:
        return fdiv(self.x(value), self.lag(value, n)) - 1.0

    # -- rolling aggregates ----------------------------------------------
    def agg(self, agg: Column, value, lo: int, hi: int = 0, min_rows: int | None = None) -> Column:
        """Aggregate over a rows frame; NULL until the frame holds min_rows values."""
        need = (hi - lo + 1) if min_rows is None else min_rows
        return F.when(self.over(F.count(self.x(value)), lo, hi) >= need, self.over(agg, lo, hi))

    def mean(self, value, n: int, min_rows: int | None = None) -> Column:
        return self.agg(F.avg(self.x(value)), value, -(n - 1), 0, min_rows)

    def sum(self, value, n: int, min_rows: int | None = None) -> Column:
        return self.agg(F.sum(self.x(value)), value, -(n - 1), 0, min_rows)

    def std(self, value, n: int, min_rows: int | None = None) -> Column:
        return self.agg(F.stddev_samp(self.x(value)), value, -(n - 1), 0, min_rows)

    def std_pop(self, value, n: int) -> Column:
        return self.agg(F.stddev_pop(self.x(value)), value, -(n - 1))

    def var(self, value, n: int) -> Column:
        return self.agg(F.var_samp(self.x(value)), value, -(n - 1))

    def min(self, value, n: int) -> Column:
        return self.agg(F.min(self.x(value)), value, -(n - 1))

    def max(self, value, n: int) -> Column:
        return self.agg(F.max(self.x(value)), value, -(n - 1))

    def quantile(self, value, n: int, q: float) -> Column:
        return self.agg(F.percentile(self.x(value), q), value, -(n - 1))

    def median(self, value, n: int) -> Column:
        return self.quantile(value, n, 0.5)

    def skew(self, value, n: int) -> Column:
        """Bias-corrected skewness; 0 for a flat frame."""
        value = self.x(value)
        factor = math.sqrt(n * (n - 1)) / (n - 2)
        flat = self.over(F.max(value), -(n - 1)) == self.over(F.min(value), -(n - 1))
        raw = self.agg(F.skewness(value), value, -(n - 1))
        return F.when(flat & self.mean(value, n).isNotNull(), F.lit(0.0)).otherwise(raw * factor)

    def _pair(self, a, b):
        a, b = self.x(a), self.x(b)
        both = a.isNotNull() & b.isNotNull()
        return F.when(both, a), F.when(both, b)

    def corr(self, a, b, n: int) -> Column:
        """Pearson correlation of n complete pairs; NULL when one side is flat."""
        a, b = self._pair(a, b)
        get = lambda agg: self.over(agg, -(n - 1))
        spread = get(F.stddev_pop(a)) * get(F.stddev_pop(b))
        live = (get(F.count(a)) >= n) & (get(F.max(a)) > get(F.min(a))) & (get(F.max(b)) > get(F.min(b)))
        return F.when(live, F.try_divide(get(F.covar_pop(a, b)), spread))

    def cov(self, a, b, n: int) -> Column:
        a, b = self._pair(a, b)
        return self.agg(F.covar_samp(a, b), a, -(n - 1))

    def slope(self, value, n: int, lo: int | None = None) -> Column:
        """Least-squares slope on the row index over n rows (ending at the row, or from lo)."""
        lo = -(n - 1) if lo is None else lo
        return self.agg(F.regr_slope(self.x(value), F.col("pos").cast("double")), value, lo, lo + n - 1)

    def time_corr(self, value, n: int) -> Column:
        """Correlation with the row position; 0 for a flat frame."""
        value = self.x(value)
        full = self.over(F.count(value), -(n - 1)) >= n
        return F.when(full, F.coalesce(self.corr(value, F.col("pos").cast("double"), n), F.lit(0.0)))

    def rank_pct(self, value, n: int) -> Column:
        """Average-tie rank of the current value in the last n rows, over n; NULL unless all n rows have a value.

        Not for use inside a window of the same feature: ranks are worked out after the layer's windows.
        """
        self.need(n - 1)
        key = (str(self.x(value)), n)
        if key not in self.ranks:
            self.ranks[key] = (f"_r{len(self.ranks)}_", self.x(value), n)
        return F.col(self.ranks[key][0])

    def mean_abs_dev(self, value, n: int) -> Column:
        rows = self.over(F.collect_list(self.x(value)), -(n - 1))
        mean = self.over(F.avg(self.x(value)), -(n - 1))
        total = F.aggregate(rows, F.lit(0.0), lambda acc, v: acc + F.abs(v - mean))
        return F.when(F.size(rows) == n, total / float(n))

    def wma(self, value, n: int) -> Column:
        """Mean with weights 1..n, newest heaviest."""
        value = self.x(value)
        weight = n * (n + 1) / 2.0
        out = value * (n / weight)
        for k in range(1, n):
            out = out + self.lag(value, k) * ((n - k) / weight)
        return out

    def share(self, cond: Column, n: int) -> Column:
        """Share of rows where the condition holds (an unknown condition counts as false)."""
        return self.mean(F.when(cond, 1.0).otherwise(0.0), n)

    def window_list(self, value, lo: int, hi: int) -> Column:
        return self.over(F.collect_list(self.x(value)), lo, hi)

    # -- exponential means -----------------------------------------------
    def _decayed(self, value: Column, decay: float, keys, offset: Column, memory: int):
        """Running sums of value / decay**offset and of the weights, inside keys."""
        run = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        grow = F.pow(F.lit(1.0 / decay), offset)
        shrink = F.pow(F.lit(decay), offset)
        total = self.once(F.sum(value * grow).over(run), memory)
        weight = lambda: self.once(F.sum(F.when(value.isNotNull(), grow)).over(run), memory)
        return total, weight, shrink

    def _decay_plan(self, value, decay: float, combine) -> Column:
        """Evaluate combine() on running decayed sums.

        Rows older than the memory of the decay (weight under 1e-15) do not
        matter, so a block overlap of that many rows is exact in double
        precision. Offsets restart in two staggered epochs where the powers
        would leave the double range; each row reads the epoch that already
        covers the memory.
        """
        value = self.x(value)
        rate = -math.log(decay)
        memory = math.ceil(-math.log(EWM_TOLERANCE) / rate)
        offset = F.col("pos") - self.start
        epoch = int(MAX_EXPONENT / rate)
        if self.rows <= epoch:
            return combine(*self._decayed(value, decay, self.keys, offset, memory))
        half = epoch // 2
        even = self._decayed(value, decay, self.keys + [F.floor(offset / epoch)], offset % epoch, memory)
        odd_off = offset + half
        odd = self._decayed(value, decay, self.keys + [F.floor(odd_off / epoch)], odd_off % epoch, memory)
        use_even = (offset < half) | (offset % epoch >= half)
        return F.when(use_even, combine(*even)).otherwise(combine(*odd))

    def ewm(self, value, span: float | None = None, alpha: float | None = None) -> Column:
        """Exponential mean with normalised weights."""
        alpha = alpha if alpha is not None else 2.0 / (span + 1.0)
        return self._decay_plan(value, 1.0 - alpha, lambda s, w, k: F.try_divide(s, w()))

    def ewm_recursive(self, value, alpha: float) -> Column:
        """y = (w y + a x) / (w + a) with w = (1-a)^g, g rows after the value before; the first value is the seed.

        Without gaps this is (1-a) y + a x. Across NULLs the old mean has decayed for g rows and the weights are made to sum to
        1; NULL rows keep the last mean. Each value multiplies what came before by w / (w + a), counted as powers of 1 - a.
        """
        decay, value = 1.0 - alpha, self.x(value)
        rate = -math.log(decay)
        memory = math.ceil(-math.log(EWM_TOLERANCE) / rate)
        known, pos = value.isNotNull(), F.col("pos")

        def mean(keys):
            w = W.partitionBy(*keys).orderBy("pos")
            before = self.once(F.last(F.when(known, pos), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
            old = F.pow(F.lit(decay), pos - before)
            run = w.rowsBetween(W.unboundedPreceding, 0)
            power = F.when(known & before.isNotNull(), F.when(pos - before == 1, 1.0).otherwise(-F.ln(old / (old + alpha)) / rate)).otherwise(0.0)
            spent = self.once(F.sum(power).over(run))
            share = F.when(before.isNull(), 1.0).when(pos - before == 1, alpha).otherwise(alpha / (old + alpha))
            return self.once(F.sum(share * value * F.pow(F.lit(1.0 / decay), spent)).over(run), memory) * F.pow(F.lit(decay), spent)

        epoch = int(MAX_EXPONENT / rate)
        if self.rows <= epoch:
            return mean(self.keys)
        offset, half = pos - self.start, epoch // 2
        use_even = (offset < half) | (offset % epoch >= half)
        return F.when(use_even, mean(self.keys + [F.floor(offset / epoch)])).otherwise(mean(self.keys + [F.floor((offset + half) / epoch)]))

    def recurrence(self, value, decay: float) -> Column:
        """v = decay * v + u, starting from 0 before the first value."""
        return self._decay_plan(value, decay, lambda s, w, k: s * k)
