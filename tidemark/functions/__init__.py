from tidemark.functions.expr import (  # noqa: F401
    TRADING_DAYS, clip, col_safe, full_window, log_step, n_long_short, rounded, safe_corr,
    safe_div, trailing,
)
