"""Fixed values that results depend on: the ticker universe and its sectors."""

# Named ticker sets, in their usual order.
MAG7 = ["AAPL", "MSFT", "GOOG", "NVDA", "TSLA", "AMZN", "META"]

# Sector of each mapped ticker; all others are "unknown".
SECTORS = {
    "tech": ["AAPL", "MSFT", "GOOG", "NVDA", "TSLA", "AMZN", "META", "NFLX", "AMD", "INTC"],
    "finance": ["JPM", "BAC", "GS"],
    "healthcare": ["JNJ", "PFE"],
}

# The extended universe (large technology names and market indicators).
UNIVERSE = MAG7 + [
    "CRM", "ADBE", "NOW", "ORCL", "NFLX", "AMD", "INTC", "CSCO", "AVGO", "TXN", "QCOM", "MU", "AMAT", "LRCX",
    "KLAC", "MRVL", "SNPS", "CDNS", "FTNT", "PANW", "INTU", "UBER", "ZM", "DDOG", "QQQ", "XLK", "SPY",
]
