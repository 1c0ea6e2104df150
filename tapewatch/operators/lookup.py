"""Reports of given wallets: everything that their figures need, and nothing of other markets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Categories that a report leaves out.
OUT_OF_SCOPE = ("Sports", "Crypto", "Weather", "Other")
#: Wallets or markets that are sent to all tasks at most.
FEW = 100_000


def _few(keys: DataFrame) -> DataFrame:
    """Broadcast as long as there are few; a join like any other beyond."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def closure(trades: DataFrame, wallets: DataFrame) -> DataFrame:
    """All trades of the markets that ``wallets`` (``wallet``) traded in: a market's figures need all of its traders.

    Wallets cut the trades to find their markets, markets cut them again; both filters run where trades are read.
    """
    asked = _few(wallets.select("wallet").distinct())
    markets = trades.join(asked, "wallet", "left_semi").select("cond").distinct()
    return trades.join(_few(markets), "cond", "left_semi")


def in_scope(bets: DataFrame, wallets: DataFrame) -> DataFrame:
    """The bets of ``wallets`` that a report counts."""
    own = bets.join(_few(wallets.select("wallet").distinct()), "wallet", "left_semi")
    return own.where(~F.coalesce(F.col("category"), F.lit("")).isin(*OUT_OF_SCOPE))
