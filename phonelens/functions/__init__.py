from phonelens.functions.expr import (
    safe_ratio, np_round, zero_sum, nan_text, stable, ratio_or_null,
    hour_of, day_of, date_of, time_of, sig_round, parse_datetime, month_of,
)
from phonelens.functions.grain import fan_out_aggregate, is_grain, grain_value

__all__ = [
    "safe_ratio", "np_round", "zero_sum", "nan_text", "stable", "ratio_or_null",
    "hour_of", "day_of", "date_of", "time_of", "sig_round", "parse_datetime", "month_of",
    "fan_out_aggregate", "is_grain", "grain_value",
]
