"""A widely used set of price and volume features; the default configuration has 158."""

from __future__ import annotations

from panelforge.expr import Input, Node
from panelforge.functions.text import parse

DEFAULT = {"kbar": {}, "price": {"windows": [0], "feature": ["OPEN", "HIGH", "LOW", "VWAP"]}, "rolling": {}}

# Bar shapes by name.
KBAR: dict[str, str] = {
    "KMID": "(close - open) / open",
    "KLEN": "(high - low) / open",
    "KMID2": "(close - open) / (high - low + 1e-12)",
    "KUP": "(high - max(open, close)) / open",
    "KUP2": "(high - max(open, close)) / (high - low + 1e-12)",
    "KLOW": "(min(open, close) - low) / open",
    "KLOW2": "(min(open, close) - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / open",
    "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
}

# Look-back features by name; d is the window. The key of MIN in include and
# exclude lists is LOW.
ROLLING: dict[str, str] = {
    "ROC": "delay(close, d) / close",
    "MA": "mean(close, d) / close",
    "STD": "std(close, d) / close",
    "BETA": "slope(close, d) / close",
    "RSQR": "rsquare(close, d)",
    "RESI": "resi(close, d) / close",
    "MAX": "ts_max(high, d) / close",
    "MIN": "ts_min(low, d) / close",
    "QTLU": "quantile(close, d, 0.8) / close",
    "QTLD": "quantile(close, d, 0.2) / close",
    "RANK": "ts_rank(close, d) / d",
    "RSV": "clip((close - ts_min(low, d)) / (ts_max(high, d) - ts_min(low, d) + 1e-12), 10)",
    "IMAX": "argmax(high, d) / d",
    "IMIN": "argmin(low, d) / d",
    "IMXD": "(argmax(high, d) - argmin(low, d)) / d",
    "CORR": "finite(corr(close, log(volume + 1), d))",
    "CORD": "finite(corr(close / last_close, log(volume / (last_volume + 1e-12) + 1), d))",
    "CNTP": "mean(flag(close > last_close), d)",
    "CNTN": "mean(flag(close < last_close), d)",
    "CNTD": "mean(flag(close > last_close), d) - mean(flag(close < last_close), d)",
    "SUMP": "sum(max(close - last_close, 0), d) / (sum(abs(close - last_close), d) + 1e-12)",
    "SUMN": "sum(max(last_close - close, 0), d) / (sum(abs(close - last_close), d) + 1e-12)",
    "SUMD": "(sum(max(close - last_close, 0), d) - sum(max(last_close - close, 0), d)) / (sum(abs(close - last_close), d) + 1e-12)",
    "VMA": "mean(volume, d) / (volume + 1e-12)",
    "VSTD": "std(volume, d) / (volume + 1e-12)",
    "WVMA": "q = abs(close / last_close - 1) * volume; std(q, d) / (mean(q, d) + 1e-12)",
    "VSUMP": "sum(max(volume - last_volume, 0), d) / (sum(abs(volume - last_volume), d) + 1e-12)",
    "VSUMN": "sum(max(last_volume - volume, 0), d) / (sum(abs(volume - last_volume), d) + 1e-12)",
    "VSUMD": "(sum(max(volume - last_volume, 0), d) - sum(max(last_volume - volume, 0), d)) / (sum(abs(volume - last_volume), d) + 1e-12)",
}
WINDOWS = (5, 10, 20, 30, 60)


def alpha158(config: dict | None = None, vwap: Node | None = None) -> dict[str, Node]:
    """Name -> factor. Keys of config: kbar, price {windows, feature}, volume {windows} and
    rolling {windows, include, exclude}; a key that is absent leaves its group out. A price
    feature is the name of a series or a pair (name, series)."""
    config = DEFAULT if config is None else config
    base: dict = {k: Input(k) for k in ("open", "high", "low", "close", "volume")}
    base["vwap"] = vwap if vwap is not None else Input("amount") / (base["volume"] + 1e-6)
    base["last_close"], base["last_volume"] = parse("delay(close, 1)", base), parse("delay(volume, 1)", base)
    out: dict[str, Node] = {}
    if "kbar" in config:
        out |= {k: parse(v, base) for k, v in KBAR.items()}
    if "price" in config:
        for field in config["price"].get("feature", ["OPEN", "HIGH", "LOW"]):
            name, own = (field, base[field.lower()]) if isinstance(field, str) else field
            for d in config["price"].get("windows", range(5)):
                out[f"{name.upper()}{d}"] = parse(f"delay(own, {d}) / close" if d else "own / close", base | {"own": own})
    if "volume" in config:
        for d in config["volume"].get("windows", range(5)):
            out[f"VOLUME{d}"] = parse(f"delay(volume, {d}) / (volume + 1e-12)" if d else "volume / (volume + 1e-12)", base)
    if "rolling" in config:
        rolling = config["rolling"]
        include, exclude = rolling.get("include"), rolling.get("exclude", [])
        for name, text in ROLLING.items():
            key = "LOW" if name == "MIN" else name
            if (include is None or key in include) and key not in exclude:
                out |= {f"{name}{d}": parse(text, base | {"d": d}) for d in rolling.get("windows", WINDOWS)}
    return out
