"""Column-expression layer: parsing, recoding, numeric helpers, fixed values."""

from plotwise.functions import numeric, recode, rules, text  # noqa: F401
