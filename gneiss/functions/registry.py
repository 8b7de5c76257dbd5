"""Functions by name: scripts in Python that run as vectorised functions, and libraries of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def evaluate(f: Callable, returns: str, *args: Column) -> Column:
    """EVAL: f of Series, or of plain values if f.by_row is set, over columns."""
    by_row = getattr(f, "by_row", False)

    @F.pandas_udf(returns)
    def run(*series: pd.Series) -> pd.Series:
        if by_row:
            return pd.Series([f(*x) for x in zip(*series, strict=True)])
        return f(*series)

    return run(*args)


class Scripts:
    """The cache of scripts: SCRIPT LOAD, EXISTS, FLUSH and EVALSHA. A script is an expression over named columns that
    pandas can evaluate, kept by the SHA-1 of its text."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def load(self, text: str) -> str:
        digest = hashlib.sha1(text.encode()).hexdigest()
        self.known[digest] = text
        return digest

    def exists(self, *digests: str) -> list[bool]:
        return [d.lower() in self.known for d in digests]

    def flush(self) -> None:
        self.known.clear()

    def run(self, digest: str, returns: str, **arguments: Column) -> Column:
        """EVALSHA: the script's value, with columns for its names."""
        if digest.lower() not in self.known:
            raise KeyError(f"no script {digest}")
        text, names = self.known[digest.lower()], list(arguments)

        def script(*series: pd.Series) -> pd.Series:
            return pd.DataFrame(dict(zip(names, series, strict=True))).eval(text)

        return evaluate(script, returns, *arguments.values())


class Functions:
    """Libraries of functions: FUNCTION LOAD, LIST, DELETE, DUMP, RESTORE and FCALL. Loaded ones are SQL functions too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.libraries: dict[str, dict[str, tuple[Callable, str, bool]]] = {}

    def load(self, library: str, functions: dict[str, tuple[Callable, str]], replace: bool = False, read_only: bool = True) -> None:
        """functions: name -> (f of Series, its SQL return type)."""
        if library in self.libraries and not replace:
            raise KeyError(f"{library} already exists")
        taken = {n: lib for lib, own in self.libraries.items() if lib != library for n in own}
        if clash := [n for n in functions if n in taken]:
            raise KeyError(f"{clash[0]} already exists in {taken[clash[0]]}")
        self.libraries[library] = {n: (f, kind, read_only) for n, (f, kind) in functions.items()}
        for name, (f, kind) in functions.items():
            self.spark.udf.register(name, self._udf(f, kind))

    @staticmethod
    def _udf(f: Callable, kind: str):
        @F.pandas_udf(kind)
        def run(*series: pd.Series) -> pd.Series:
            return f(*series)

        return run

    def call(self, name: str, *args: Column, read_only: bool = False) -> Column:
        """FCALL, FCALL_RO."""
        for own in self.libraries.values():
            if name in own:
                f, kind, safe = own[name]
                if read_only and not safe:
                    raise PermissionError(f"{name} writes")
                return evaluate(f, kind, *args)
        raise KeyError(f"no function {name}")

    def list(self) -> DataFrame:
        rows = [(lib, n, kind) for lib, own in sorted(self.libraries.items()) for n, (_, kind, _) in sorted(own.items())]
        return self.spark.createDataFrame(rows, "library string, name string, returns string")

    def delete(self, library: str) -> None:
        if library not in self.libraries:
            raise KeyError(f"no library {library}")
        for name in self.libraries.pop(library):
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def dump(self) -> bytes:
        from pyspark import cloudpickle

        return cloudpickle.dumps(self.libraries)

    def restore(self, data: bytes, policy: str = "append") -> None:
        """policy: append (names must be free), replace, or flush (only what is restored stays)."""
        from pyspark import cloudpickle

        restored = cloudpickle.loads(data)
        if policy == "flush":
            for library in list(self.libraries):
                self.delete(library)
        for library, own in restored.items():
            self.load(library, {n: (f, kind) for n, (f, kind, _) in own.items()}, replace=policy == "replace")


def embedder(f: Callable[[list[str]], list[list[float]]]):
    """A column function from texts to vectors, for a model that is given as a function of a list of texts."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(f(texts.tolist())))

    return run
