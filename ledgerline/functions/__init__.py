from ledgerline.functions.exprs import (  # noqa: F401
    NUMERIC, SUM_NUMERIC, LOCAL_ZONE, blank_to_null, to_numeric, text_to_int, to_bool,
    to_instant, naive_utc, local_date, parse_or_default, money_round, iso_instant,
    normalise_type, credit_flag, loan_pred, credit_pred, zero_if_null, sum_if,
)
