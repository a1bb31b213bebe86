"""Readers and writers by name, and the choice of a reader from the options of a run.

A reader takes (spark, path, **options) and returns its tables by name; a writer takes (df or tables, path). New ones are
added with ``reader`` and ``writer``, as an analysis is with ``analysis``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

READERS: dict[str, Callable[..., dict[str, DataFrame]]] = {}
WRITERS: dict[str, Callable[..., None]] = {}
ANALYSES: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def reader(name: str):
    return lambda f: READERS.setdefault(name, f)


def writer(name: str):
    return lambda f: WRITERS.setdefault(name, f)


def analysis(name: str):
    """An analysis is called with (cohort, **options) and returns tables by name."""
    return lambda f: ANALYSES.setdefault(name, f)


def run(name: str, cohort: Any, **options) -> dict[str, DataFrame]:
    if name not in ANALYSES:
        raise KeyError(f"no analysis {name}: {', '.join(sorted(ANALYSES))}")
    return ANALYSES[name](cohort, **options)


def read(spark: SparkSession, name: str, path: str | list[str], **options) -> dict[str, DataFrame]:
    if name not in READERS:
        raise KeyError(f"no reader {name}: {', '.join(sorted(READERS))}")
    return READERS[name](spark, path, **options)


def write(name: str, tables: Any, path: str, **options) -> None:
    if name not in WRITERS:
        raise KeyError(f"no writer {name}: {', '.join(sorted(WRITERS))}")
    WRITERS[name](tables, path, **options)


#: Options that name a source of genotypes, in the order in which they are looked for. One may be given.
SOURCES = ("vcf", "bed", "ped", "tped", "lgen", "gen", "dosage", "expression", "mach")


def select(options: dict[str, str]) -> tuple[str, str]:
    """The reader and path that the options name; two sources of genotypes, or none, raise. A dosage file that is a VCF is read as
    one, with its dosage field."""
    named = [k for k in SOURCES if options.get(k)]
    if len(named) != 1:
        raise ValueError("give one source of genotypes" if not named else f"more than one source: {', '.join(named)}")
    name, path = named[0], options[named[0]]
    if name == "dosage" and path.lower().removesuffix(".gz").endswith(".vcf"):
        return "vcf", path
    return name, path


def script_lines(text: str) -> list[dict[str, str | bool]]:
    """Runs of a script: a line of ``--option [value]`` each, # starts a comment, a backslash at the end continues a line.

    Values may stand in double quotes. An option without a value is True.
    """
    import shlex

    out = []
    for line in text.replace("\\\n", " ").split("\n"):
        words = shlex.split(line, comments=True)
        run: dict[str, str | bool] = {}
        for w in words:
            if w.startswith("--"):
                run[last := w[2:]] = True
            elif not run:
                raise ValueError(f"a value without an option: {w}")
            else:
                run[last] = w if run[last] is True else f"{run[last]} {w}"
        if run:
            out.append(run)
    return out
