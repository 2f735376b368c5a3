"""The 82 published formulaic alphas that need neither industries nor market values."""

from __future__ import annotations

from panelforge.expr import Input, Node
from panelforge.functions.text import parse
from panelforge.operators import WindowedAvg, returns

# Formulas by name, in the text language of functions/text.py.
# Windows and constants are those whose results are to be met.
FORMULAS: dict[str, str] = {
    "alpha001": "s = where(returns < 0, std(returns, 20), close); rank(argmax(s * s, 5))",
    "alpha002": "finite(corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6) * -1)",
    "alpha003": "finite(corr(rank(open), rank(volume), 10) * -1)",
    "alpha004": "ts_rank(rank(low), 9) * -1",
    "alpha005": "rank(open - sum(vwap, 10) / 10) * (abs(rank(close - vwap)) * -1)",
    "alpha006": "finite(corr(open, volume, 10) * -1)",
    "alpha007": "a = ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7)) * -1; where(adv(20) >= volume, -1, a)",
    "alpha008": "s = sum(open, 5) * sum(returns, 5); rank(s - delay(s, 10)) * -1",
    "alpha009": "d = delta(close, 1); where((ts_min(d, 5) > 0) | (ts_max(d, 5) < 0), d, d * -1)",
    "alpha010": "d = delta(close, 1); where((ts_min(d, 4) > 0) | (ts_max(d, 4) < 0), d, d * -1)",
    "alpha011": "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    "alpha012": "sign(delta(volume, 1)) * (-1 * delta(close, 1))",
    "alpha013": "-1 * rank(cov(rank(close), rank(volume), 5))",
    "alpha014": "-1 * (rank(delta(returns, 3)) * finite(corr(open, volume, 10)))",
    "alpha015": "-1 * sum(rank(finite(corr(rank(high), rank(volume), 3))), 3)",
    "alpha016": "-1 * rank(cov(rank(high), rank(volume), 5))",
    "alpha017": "-1 * (rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(finite(volume / adv(20)), 5)))",
    "alpha018": "-1 * rank(std(abs(close - open), 5) + (close - open) + finite(corr(close, open, 10)))",
    "alpha019": "-1 * sign(close - delay(close, 7) + delta(close, 7)) * (1 + rank(1 + sum(returns, 250)))",
    "alpha020": "-1 * (rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1)))",
    "alpha021": "m = mean(close, 8); s = std(close, 8); n = mean(close, 2); where(~(m + s < n) & ((n < m - s) | (volume / adv(20) >= 1)), 1, -1)",
    "alpha022": "-1 * delta(finite(corr(high, volume, 5)), 5) * rank(std(close, 20))",
    "alpha023": "where(mean(high, 20) < high, -1 * finite(delta(high, 2)), 0)",
    "alpha024": "where(delta(mean(close, 100), 100) / delay(close, 100) <= 0.05, -1 * (close - ts_min(close, 100)), -1 * delta(close, 3))",
    "alpha025": "rank(-1 * returns * adv(20) * vwap * (high - close))",
    "alpha026": "-1 * ts_max(finite(corr(ts_rank(volume, 5), ts_rank(high, 5), 5)), 3)",
    "alpha027": "where(rank(mean(corr(rank(volume), rank(vwap), 6), 2) / 2) > 0.5, -1, 1)",
    "alpha028": "scale(finite(corr(adv(20), low, 5)) + (high + low) / 2 - close)",
    "alpha029": "inner = scale(log(sum(rank(rank(-1 * rank(delta(close - 1, 5)))), 2))); ts_min(rank(rank(inner)), 5) + ts_rank(delay(-1 * returns, 6), 5)",
    "alpha030": "d = delta(close, 1); s = sign(d) + sign(delay(d, 1)) + sign(delay(d, 2)); (1 - rank(s)) * finite(sum(volume, 5) / sum(volume, 20), 1)",
    "alpha031": "a = rank(rank(rank(decay(-1 * rank(rank(delta(close, 10))), 10)))); a + rank(-1 * delta(close, 3)) + sign(scale(finite(corr(adv(20), low, 12))))",
    "alpha032": "scale(mean(close, 7) / 7 - close) + 20 * scale(corr(vwap, delay(close, 5), 230))",
    "alpha033": "rank(open / close - 1)",
    "alpha034": "rank(2 - rank(finite(std(returns, 2) / std(returns, 5), 1)) - rank(delta(close, 1)))",
    "alpha035": "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))",
    "alpha036": "2.21 * rank(corr(close - open, delay(volume, 1), 15)) + 0.7 * rank(open - close) + 0.73 * rank(ts_rank(delay(-1 * returns, 6), 5)) + rank(abs(corr(vwap, adv(20), 6))) + 0.6 * rank((mean(close, 200) / 200 - open) * (close - open))",
    "alpha037": "rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)",
    "alpha038": "-1 * rank(ts_rank(open, 10)) * rank(finite(close / open, 1))",
    "alpha039": "-1 * rank(delta(close, 7) * (1 - rank(decay(volume / adv(20), 9)))) * (1 + rank(mean(returns, 250)))",
    "alpha040": "-1 * rank(std(high, 10)) * finite(corr(high, volume, 10), 1)",
    "alpha041": "pow(high * low, 0.5) - vwap",
    "alpha042": "rank(vwap - close) / rank(vwap + close)",
    "alpha043": "ts_rank(finite(volume / adv(20)), 20) * ts_rank(-1 * delta(close, 7), 8)",
    "alpha044": "-1 * finite(corr(high, rank(volume), 5))",
    "alpha045": "-1 * (rank(mean(delay(close, 5), 20)) * finite(corr(close, volume, 2)) * rank(finite(corr(sum(close, 5), sum(close, 20), 2), 1)))",
    "alpha046": "s = (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10; where(s > 0.25, -1, where(s < 0, 1, -1 * delta(close, 1)))",
    "alpha047": "finite(rank(1 / close) * volume / adv(20) * (high * rank(high - close) / (mean(high, 5) / 5)) - rank(vwap - delay(vwap, 5)))",
    "alpha049": "s = (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10; where(s < -0.1, 1, -1 * delta(close, 1))",
    "alpha050": "-1 * ts_max(rank(finite(corr(rank(volume), rank(vwap), 5))), 5)",
    "alpha051": "s = (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10; where(s < -0.05, 1, -1 * delta(close, 1))",
    "alpha052": "-1 * delta(ts_min(low, 5), 5) * rank((sum(returns, 240) - sum(returns, 20)) / 220) * ts_rank(volume, 5)",
    "alpha053": "r = close - low; -1 * delta((close - low - (high - close)) / where(eq(r, 0), 0.0001, r), 9)",
    "alpha054": "r = low - high; -1 * (low - close) * pow(open, 5) / (where(eq(r, 0), 0.0001, r) * pow(close, 5))",
    "alpha055": "r = ts_max(high, 12) - ts_min(low, 12); s = (close - ts_min(low, 12)) / where(eq(r, 0), 0.0001, r); -1 * finite(corr(rank(s), rank(volume), 6))",
    "alpha057": "0 - 1 * ((close - vwap) / decay(rank(argmax(close, 30)), 2))",
    "alpha060": "r = high - low; s = (close - low - (high - close)) * volume / where(eq(r, 0), 0.0001, r); 0 - (2 * scale(rank(s)) - scale(rank(argmax(close, 10))))",
    "alpha061": "flag(rank(vwap - ts_min(vwap, 16)) < rank(corr(vwap, adv(180), 18)))",
    "alpha062": "a = rank(corr(vwap, mean(adv(20), 22), 10)); b = flag(rank(open) + rank(open) < rank((high + low) / 2) + rank(high)); flag(a < rank(b)) * -1",
    "alpha064": "a = rank(corr(mean(open * 0.178404 + low * (1 - 0.178404), 13), mean(adv(120), 13), 17)); b = rank(delta((high + low) / 2 * 0.178404 + vwap * (1 - 0.178404), 4)); flag(a < b) * -1",
    "alpha065": "a = rank(corr(open * 0.00817205 + vwap * (1 - 0.00817205), mean(adv(60), 9), 6)); flag(a < rank(open - ts_min(open, 14))) * -1",
    "alpha066": "a = finite((low * 0.96633 + low * (1 - 0.96633) - vwap) / (open - (high + low) / 2)); (rank(decay(delta(vwap, 4), 7)) + ts_rank(decay(a, 11), 7)) * -1",
    "alpha068": "a = ts_rank(corr(rank(high), rank(adv(15)), 9), 14); flag(a < rank(delta(close * 0.518371 + low * (1 - 0.518371), 1))) * -1",
    "alpha071": "a = ts_rank(decay(corr(ts_rank(close, 3), ts_rank(adv(180), 12), 18), 4), 16); b = pow(rank(low + open - (vwap + vwap)), 2); max(a, ts_rank(decay(b, 16), 4))",
    "alpha072": "a = rank(decay(corr((high + low) / 2, adv(40), 9), 10)) + 0.0001; a / (rank(decay(corr(ts_rank(vwap, 4), ts_rank(volume, 19), 7), 3)) + 0.0001)",
    "alpha073": "m = open * 0.147155 + low * (1 - 0.147155); a = rank(decay(delta(vwap, 5), 3)); -1 * max(a, ts_rank(decay(delta(m, 2) / m * -1, 3), 17))",
    "alpha074": "a = rank(corr(close, mean(adv(30), 37), 15)); b = rank(corr(rank(high * 0.0261661 + vwap * (1 - 0.0261661)), rank(volume), 11)); flag(a < b) * -1",
    "alpha075": "flag(rank(corr(vwap, volume, 4)) < rank(corr(rank(low), rank(adv(50)), 12)))",
    "alpha077": "a = rank(decay((high + low) / 2 + high - (vwap + high), 20)); min(a, rank(decay(finite(corr((high + low) / 2, adv(40), 3), 1), 6)))",
    "alpha078": "a = rank(corr(sum(low * 0.352233 + vwap * (1 - 0.352233), 20), sum(adv(40), 20), 7)); pow(a, rank(finite(corr(rank(vwap), rank(volume), 6))))",
    "alpha081": "a = pow(rank(corr(vwap, sum(adv(10), 50), 8)), 4); flag(rank(log(product(rank(a), 15))) < rank(corr(rank(vwap), rank(volume), 5))) * -1",
    "alpha083": "r = (high - low) / (sum(close, 5) / 5); rank(delay(r, 2)) * rank(rank(volume)) / (r / (vwap - close))",
    "alpha084": "pow(ts_rank(vwap - ts_max(vwap, 15), 21), delta(close, 5))",
    "alpha085": "a = rank(finite(corr(high * 0.876703 + close * (1 - 0.876703), adv(30), 10), 1)); pow(a, rank(finite(corr(ts_rank((high + low) / 2, 4), ts_rank(volume, 10), 7), 1)))",
    "alpha086": "flag(ts_rank(corr(close, mean(adv(20), 15), 6), 20) < rank(open + close - (vwap + open))) * -1",
    "alpha088": "a = rank(decay(rank(open) + rank(low) - (rank(high) + rank(close)), 8)); min(ts_rank(decay(finite(corr(ts_rank(close, 8), ts_rank(adv(60), 21), 8)), 7), 3), a)",
    "alpha092": "a = ts_rank(decay(flag((high + low) / 2 + close < low + open), 15), 19); min(ts_rank(decay(finite(corr(rank(low), rank(adv(30)), 8)), 7), 7), a)",
    "alpha094": "a = rank(vwap - ts_min(vwap, 12)); pow(a, ts_rank(finite(corr(ts_rank(vwap, 20), ts_rank(adv(60), 4), 18)), 3)) * -1",
    "alpha095": "flag(rank(open - ts_min(open, 12)) < ts_rank(pow(rank(corr(mean((high + low) / 2, 19), mean(adv(40), 19), 13)), 5), 12))",
    "alpha096": "a = ts_rank(decay(finite(corr(rank(vwap), rank(volume), 4)), 4), 8); b = argmax(finite(corr(ts_rank(close, 7), ts_rank(adv(60), 4), 4)), 13); -1 * max(a, ts_rank(decay(b, 14), 13))",
    "alpha098": "a = rank(decay(corr(vwap, mean(adv(5), 26), 5), 7)); b = argmin(finite(corr(rank(open), rank(adv(15)), 21)), 9); a - rank(decay(ts_rank(b, 7), 8))",
    "alpha099": "a = rank(corr(sum((high + low) / 2, 20), sum(adv(60), 20), 9)); flag(a < rank(corr(low, volume, 6))) * -1",
    "alpha101": "(close - open) / (high - low + 0.001)",
}


def series(vwap: Node | None = None) -> dict:
    """The named series of the formulas. vwap is amount / (volume + 1e-7) unless given."""
    base = {k: Input(k) for k in ("open", "high", "low", "close", "volume")}
    base["vwap"] = vwap if vwap is not None else Input("amount") / (base["volume"] + 1e-7)
    base["returns"] = returns(base["close"])
    return base | {"adv": lambda n: WindowedAvg(base["volume"], n)}


def alpha101(names: list[str] | None = None, vwap: Node | None = None) -> dict[str, Node]:
    scope = series(vwap)
    return {k: parse(FORMULAS[k], scope) for k in names or FORMULAS}
