"""Scalar transforms of label columns: dates, logs, licences, memory, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes per parameter by storage type.
BYTES_PER_PARAM = {"fp32": 4.0, "fp16": 2.0, "bf16": 2.0, "fp8": 1.0, "awq": 0.5, "gptq": 0.5}
GB = 1e9
PARAMS_PER_B = 1e9

# Licences that count as permissive.
PERMISSIVE = (
    "apache-2.0",
    "mit",
    "bsd",
    "bsd-2-clause",
    "bsd-3-clause",
    "bsd-3-clause-clear",
    "cc0-1.0",
    "cc-by-4.0",
    "cc-by-sa-4.0",
    "artistic-2.0",
    "mpl-2.0",
    "unlicense",
    "wtfpl",
    "isc",
    "zlib",
    "postgresql",
    "lgpl-3.0",
    "gpl-3.0",
    "agpl-3.0",
)

#: Day zero of upload ages.
EPOCH = "2022-01-01T00:00:00Z"


def bytes_per_param(dtype: Column) -> Column:
    """Width of a storage type; an unknown type is an error, a missing one NULL."""
    key = F.lower(F.trim(dtype))
    out = F.when(key.isNull(), F.lit(None).cast("double"))
    for name, width in BYTES_PER_PARAM.items():
        out = out.when(key == name, F.lit(width))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown dtype "), key)).cast("double"))


def served_vram_gb(weight_bytes: Column, quant: Column, serve_quant: Column, params_b: Column) -> Column:
    """Served memory: measured bytes rescaled to the served type, else parameters times its width."""
    served = bytes_per_param(F.nullif(serve_quant, F.lit("")))
    measured = (weight_bytes > 0) & (F.coalesce(quant, F.lit("")) != "")
    from_bytes = weight_bytes * served / bytes_per_param(F.nullif(quant, F.lit(""))) / GB
    from_params = params_b * PARAMS_PER_B * served / GB
    return F.when(F.coalesce(measured, F.lit(False)), from_bytes).when(params_b > 0, from_params)


def iso_date(raw: Column) -> Column:
    """ISO date from the first ten characters; "" when there is none.

    Only month 1-12 and day 1-31 are required, so 30 February passes.
    """
    head = F.substring(F.trim(raw), 1, 10)
    part = [F.regexp_extract(head, r"^(\d+)-(\d+)-(\d+)$", i) for i in (1, 2, 3)]
    y, m, d = (p.try_cast("int") for p in part)
    ok = m.between(1, 12) & d.between(1, 31) & y.isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), F.format_string("%04d-%02d-%02d", y, m, d)).otherwise(F.lit(""))


def days_since_epoch(stamp: Column) -> Column:
    """Days since 2022-01-01 UTC; a stamp without a zone is read as UTC."""
    at = F.try_to_timestamp(F.nullif(stamp, F.lit("")))
    zero = F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    return (F.unix_micros(at) - zero) / F.lit(86_400_000_000.0)


def log10_1p(x: Column) -> Column:
    return F.when(x >= 0, F.log10(1 + x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def finite(x: Column) -> Column:
    """The value as a double; text that is no number, NaN and infinities become NULL."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def license_type(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", "unknown").when(
        F.lower(F.trim(raw)).isin(*PERMISSIVE), "permissive"
    ).otherwise("restrictive")


def architecture_family(model_type: Column) -> Column:
    return F.when(F.coalesce(model_type, F.lit("")) == "", "unknown").otherwise(F.lower(model_type))


def repo_key(name: Column) -> Column:
    """Bare lower-cased repository name."""
    bare = F.element_at(F.split(F.element_at(F.split(name, "/"), -1), "__"), -1)
    return F.lower(F.trim(bare))


def match_key(name: Column) -> Column:
    """Join key of a published name: organisation, case and punctuation dropped."""
    last = F.element_at(F.split(F.replace(name, F.lit("/"), F.lit("__")), "__"), -1)
    return F.regexp_replace(F.lower(last), "[^a-z0-9]", "")


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))
