"""Which built-in factors there are, and which of them are the same by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators.collect import with_vwap
from ..expr import Node
from ..kernel import with_kernels
from . import alpha158, provider, purified, technical, temporal

#: Dropped name -> the one that is kept for it.
DUPLICATES = {
    **{f"TEMP_rsv_{w}": f"RSV{w}" for w in alpha158.WINDOWS}, **{f"TEMP_corr_cv_{w}": f"CORR{w}" for w in alpha158.WINDOWS},
    **{f"TEMP_ret_{w}": f"LGBM_ret_{w}" for w in (20, 60)}, **{f"TEMP_ma_gap_{w}": f"LGBM_dist_ma{w}" for w in (20, 60, 120)},
    "TEMP_std_60": "LGBM_std_60", "TEMP_amihud_20": "LGBM_amihud_20", "TEMP_turnover_mean_20": "LGBM_turnover_20", "TEMP_high_gap_20": "LGBM_dist_high_20", "TEMP_low_gap_20": "LGBM_dist_low_20",
}


def canonical(names: list[str]) -> list[str]:
    """Names without those whose kept twin is among them; a dropped name alone is redirected to its twin. Order stays."""
    return list(dict.fromkeys(DUPLICATES.get(n, n) for n in names))


def registry(provider_source: bool = True, canonicalize: bool = True) -> dict[str, Node]:
    """All built-in factors by name."""
    out = alpha158.factors() | purified.factors() | temporal.factors() | technical.factors() | (provider.factors() if provider_source else {})
    return {k: x for k, x in out.items() if k not in DUPLICATES} if canonicalize else out


def generate(panel: DataFrame, names: list[str] | None = None, provider_source: bool = True, keep: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The panel's keys and the named factors (all by default) as FLOAT columns, by the numpy kernels. Absent source columns count as missing."""
    known = registry(provider_source)
    wanted = list(known) if names is None else canonical(names)
    missing = [n for n in wanted if n not in known]
    if missing:
        raise ValueError(f"unknown factors: {', '.join(missing)}")
    have = set(panel.columns)
    needed = {a for n in wanted for a in sources(known[n])}
    if "vwap" in needed and "vwap" not in have:
        panel = with_vwap(panel)
        have.add("vwap")
    if "limit_pre_close" in needed and "limit_pre_close" not in have and "pre_close" in have:
        panel = panel.withColumn("limit_pre_close", F.col("pre_close"))
        have.add("limit_pre_close")
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in sorted(needed - have)}) if needed - have else panel
    return with_kernels(panel, {n: known[n] for n in wanted}, keep=list(keep), floats=True)


def sources(n: Node) -> set[str]:
    """Columns that a formula reads."""
    if n.op == "column":
        return {n.args[0]}
    return {c for a in n.args if isinstance(a, Node) for c in sources(a)}
