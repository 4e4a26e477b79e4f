"""Rule strategies as window expressions.

A strategy is a registry of columns ``<name>__position``, ``__entry``, ``__stop``,
``__target`` and ``__strength``; several strategies run in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import clip, fdiv
from ..plans.core_features import CORE
from ..plans.registry import Registry

PARTS = ("position", "entry", "stop", "target", "strength")


@dataclass(frozen=True)
class RsiRules:
    name: str = "rsi_mean_reversion"
    rsi: str = "rsi_14"
    oversold: float = 30.0
    overbought: float = 70.0
    neutral_low: float = 40.0
    neutral_high: float = 60.0
    exit_on_neutral: bool = True
    damp: bool = True
    min_strength: float = 0.0
    max_position: float = 0.1

    def check(self) -> bool:
        if self.oversold >= self.neutral_low:
            raise ValueError("Oversold threshold should be below neutral zone lower")
        if self.overbought <= self.neutral_high:
            raise ValueError("Overbought threshold should be above neutral zone upper")
        if self.neutral_high <= self.neutral_low:
            raise ValueError("Neutral zone lower must be less than upper")
        return True

    @property
    def needs(self):
        return ["open", "high", "low", "close", "volume", self.rsi, "atr"]


@dataclass(frozen=True)
class MacdRules:
    name: str = "macd_momentum"
    signal_threshold: float = 0.0
    histogram_threshold: float = 0.0
    confirm: bool = True
    # The code that defines these rules zeroes its own entries when this is on,
    # although its tests expect them; off keeps the entries.
    zero_on_cross: bool = False
    damp: bool = True
    min_strength: float = 0.0
    max_position: float = 0.1

    def check(self) -> bool:
        return True

    @property
    def needs(self):
        return ["open", "high", "low", "close", "volume", "macd", "macd_signal", "macd_histogram", "atr"]


def _known(cond):
    return F.coalesce(cond, F.lit(False))


def _levels(reg: Registry, name: str):
    """Entry price, 2 ATR stop and 3 ATR target where an entry fires."""
    side = lambda f: F.when(f[f"_{name}_long"], 1.0).when(f[f"_{name}_short"], -1.0)
    reg.add(
        name,
        **{
            f"{name}__entry": lambda f: F.when(side(f).isNotNull(), f["close"]),
            f"{name}__stop": lambda f: f["close"] - side(f) * 2.0 * f["atr"],
            f"{name}__target": lambda f: f["close"] + side(f) * 3.0 * f["atr"],
        },
    )


def _damping(f):
    """1 minus the excess of relative range over its recent mean, between 0 and 1."""
    ratio = clip(fdiv(f["_atr_norm"], f.mean("_atr_norm", 20, 1)), 0.0, 2.0)
    return 1.0 - clip(ratio - 1.0, 0.0, 1.0)


def _finish(reg: Registry, rules):
    """Weak-signal filter and position limit."""
    name = rules.name

    def position(f):
        raw = f[f"_{name}_raw"]
        kept = F.when(f[f"{name}__strength"] < rules.min_strength, 0.0).otherwise(raw) if rules.min_strength > 0 else raw
        return clip(kept, -rules.max_position, rules.max_position)

    reg.add(name, **{f"{name}__position": position})


def rsi_strategy(rules: RsiRules = RsiRules(), parent: Registry = CORE) -> Registry:
    rules.check()
    reg, name = Registry(parent=parent), rules.name

    def edge(f, cond):
        return _known(cond(f[rules.rsi])) & ~_known(cond(f.lag(rules.rsi)))

    def raw(f):
        r, before = f[rules.rsi], f.lag(rules.rsi)
        out = F.when(f[f"_{name}_long"], 1.0).when(f[f"_{name}_short"], -1.0).otherwise(0.0)
        if rules.exit_on_neutral:
            leave = ((r > rules.neutral_low) & (before <= rules.neutral_low)) | (
                (r < rules.neutral_high) & (before >= rules.neutral_high)
            )
            out = F.when(_known(leave), 0.0).otherwise(out)
        return out

    def strength(f):
        r, side = f[rules.rsi], f[f"_{name}_raw"]
        value = (
            F.when(side > 0, clip((rules.oversold - r) / rules.oversold, 0.0, 1.0))
            .when(side < 0, clip((r - rules.overbought) / (100.0 - rules.overbought), 0.0, 1.0))
            .otherwise(0.0)
        )
        return F.coalesce(value * _damping(f) if rules.damp else value, F.lit(0.0))

    reg.add(
        name,
        _atr_norm=lambda f: fdiv(f["atr"], f["close"]),
        **{
            f"_{name}_long": lambda f: edge(f, lambda r: r < rules.oversold),
            f"_{name}_short": lambda f: edge(f, lambda r: r > rules.overbought),
            f"_{name}_raw": raw,
            f"{name}__strength": strength,
        },
    )
    _levels(reg, name)
    _finish(reg, rules)
    return reg


def rsi_extremity(rsi, rules: RsiRules = RsiRules()):
    """Distance of a value past the band, 0 inside it."""
    return (
        F.when(rsi <= rules.oversold, (rules.oversold - rsi) / rules.oversold)
        .when(rsi >= rules.overbought, (rsi - rules.overbought) / (100.0 - rules.overbought))
        .otherwise(0.0)
    )


def macd_strategy(rules: MacdRules = MacdRules(), parent: Registry = CORE) -> Registry:
    rules.check()
    reg, name = Registry(parent=parent), rules.name

    def crossed(f, sign):
        """The line moves to the other side of the signal; before the first row both are 0."""
        gap = sign * (f["macd"] - f["macd_signal"])
        before = F.coalesce(sign * (f.lag("macd") - f.lag("macd_signal")), F.when(f["pos"] == 0, 0.0))
        hit = (gap > rules.signal_threshold) & (before <= rules.signal_threshold)
        if rules.confirm:
            hit = hit & (sign * f["macd_histogram"] > rules.histogram_threshold)
        return _known(hit)

    def raw(f):
        if rules.zero_on_cross:
            return F.lit(0.0) * f["macd"]
        return F.when(f[f"_{name}_long"], 1.0).when(f[f"_{name}_short"], -1.0).otherwise(0.0)

    def strength(f):
        spread = f.std("macd_histogram", 20, 1)
        scaled = fdiv(f["macd_histogram"], F.when(spread == 0, 1.0).otherwise(spread))
        side = F.signum(f[f"_{name}_raw"])
        value = F.when(side != 0, clip(side * scaled, 0.0, 3.0) / 3.0).otherwise(0.0)
        return clip(F.coalesce(value * _damping(f) if rules.damp else value, F.lit(0.0)), 0.0, 1.0)

    reg.add(
        name,
        _atr_norm=lambda f: fdiv(f["atr"], f["close"]),
        **{
            f"_{name}_long": lambda f: crossed(f, 1.0),
            f"_{name}_short": lambda f: crossed(f, -1.0),
            f"_{name}_raw": raw,
            f"{name}__strength": strength,
        },
    )
    _levels(reg, name)
    _finish(reg, rules)
    return reg


STRATEGIES = {"rsi_mean_reversion": (rsi_strategy, RsiRules), "macd_momentum": (macd_strategy, MacdRules)}


def run_strategy(bars: DataFrame, name: str, rules=None, keep=("close",)) -> DataFrame:
    """Signals of one strategy, tagged with its name."""
    build, default = STRATEGIES[name]
    rules = rules or default()
    wide = build(rules).compute(bars, [f"{rules.name}__{p}" for p in PARTS], keep=keep)
    return wide.select(
        "symbol", "ts", "pos", *keep, F.lit(rules.name).alias("strategy"),
        *[F.col(f"{rules.name}__{p}").alias(p) for p in PARTS],
    )


def run_strategies(bars: DataFrame, rule_sets=(RsiRules(), MacdRules()), keep=("close",)) -> DataFrame:
    """Signals of several strategies side by side, in one plan."""
    reg: Registry = CORE
    wanted = []
    for rules in rule_sets:
        build = rsi_strategy if isinstance(rules, RsiRules) else macd_strategy
        reg = build(rules, parent=reg)
        wanted += [f"{rules.name}__{p}" for p in PARTS]
    return reg.compute(bars, wanted, keep=keep)


def long_signals(wide: DataFrame, names) -> DataFrame:
    """One row per (symbol, ts, strategy)."""
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(n).alias("strategy"), *[F.col(f"{n}__{p}").alias(p) for p in PARTS]) for n in names
        ])
    )
    return wide.select("symbol", "ts", "pos", rows.alias("s")).select("symbol", "ts", "pos", "s.*")


def strategy_returns(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Previous position times return, 0 where unknown; signals carry (symbol, ts, strategy)."""
    reg = Registry(parent=CORE)
    reg.add("returns", _held=lambda f: f.lag("position"),
            strategy_return=lambda f: F.coalesce(f["_held"] * f["daily_return"], F.lit(0.0)))
    joined = signals.select("symbol", "ts", "pos", "position").join(bars.select("symbol", "ts", "close"), ["symbol", "ts"])
    return reg.compute(joined, ["strategy_return"], keep=["position"])
