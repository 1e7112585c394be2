"""Paths, file names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalvault.fixed_values import (
    CHUNK_LABEL, CONFIG_SUFFIX, LABEL_TIME_FORMAT, LOG_SEPARATOR, LOG_TIME_FORMAT,
    OUTPUT_SUFFIX, SCRATCH_PREFIX, TRANSFER_LABEL, TRANSFER_STATUS,
)


def path_of(*parts: Column | str) -> Column:
    """``shot/tree/signal``; absent (NULL) parts are left out."""
    return F.concat_ws("/", *parts)


def output_file(directory: Column | str, shot: Column | str) -> Column:
    return F.concat(_lit(directory), F.lit("/"), _col(shot), F.lit(OUTPUT_SUFFIX))


def base_name(path: Column | str, suffix: str = "") -> Column:
    """Last path component, without ``suffix`` if it ends so (and is not only that)."""
    name = F.substring_index(_col(path), "/", -1)
    if not suffix:
        return name
    cut = F.substring(name, F.lit(1), F.length(name) - len(suffix))
    return F.when(name.endswith(suffix) & (F.length(name) > len(suffix)), cut).otherwise(name)


def without_prefix(path: Column | str, prefix: str = SCRATCH_PREFIX) -> Column:
    path = _col(path)
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))
                  ).otherwise(path)


def chunk_label(config: Column | str, shot: Column | str, chunk: Column | str,
                job: Column | str, task: Column | str) -> Column:
    """Stable id of one fetch unit."""
    return F.format_string(CHUNK_LABEL, base_name(config, CONFIG_SUFFIX),
                           _col(shot), _col(chunk), _col(job), _col(task))


def transfer_label(filename: Column | str, ts: Column | str) -> Column:
    return F.concat(F.lit(TRANSFER_LABEL), _col(filename), F.lit(" "),
                    F.date_format(_col(ts), LABEL_TIME_FORMAT))


def transfer_line(ts: Column | str, shot: Column | str, filename: Column | str) -> Column:
    return F.concat_ws(LOG_SEPARATOR, F.date_format(_col(ts), LOG_TIME_FORMAT), _col(shot),
                       _col(filename), F.lit(TRANSFER_STATUS))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c
