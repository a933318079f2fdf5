from surtido.functions.exprs import (  # noqa: F401
    as_double,
    classify,
    clip,
    guarded_div,
    high_season,
    iso_week_key,
    lookup,
    min_max,
    non_zero,
    rnd,
    strip_symbols,
)
