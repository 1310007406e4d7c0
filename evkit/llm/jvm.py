"""Functions of `java/`, compiled by Janino, the compiler that Spark has for its own code, and sent to the executors.

A loop over bits or bytes that numpy can't take in few steps runs there some ten times as fast.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = Path(__file__).resolve().parent / "java"
# Class loaders by application and library.
_LOADERS: dict[tuple[str, str], object] = {}


def _bytecodes(jvm, names: tuple[str, ...]) -> dict[str, bytes]:
    """Classes of the sources, compiled together."""
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    # One unit: the package once, all imports, then all classes.
    lines = [x for n in names for x in (SOURCES / f"{n}.java").read_text().splitlines()]
    imports = sorted({x for x in lines if x.startswith("import ")})
    rest = [x for x in lines if not x.startswith(("import ", "package "))]
    compiler.cook("\n".join(["package evkit;", *imports, *rest]))
    codes = compiler.getBytecodes()
    return {n: bytes(codes[n]) for n in codes}


def library(spark: SparkSession, name: str, classes: tuple[str, ...], files: dict[str, bytes] | None = None):
    """The class loader of a jar with `classes` and `files`, which the executors get too: once per application."""
    context = spark.sparkContext
    key = (context.applicationId, name)
    if key not in _LOADERS:
        jvm = context._jvm
        path = os.path.join(tempfile.mkdtemp(prefix="evkit-"), f"evkit-{name}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for entry, code in _bytecodes(jvm, classes).items():
                jar.writestr(entry.replace(".", "/") + ".class", code)
            for entry, data in (files or {}).items():
                jar.writestr(f"evkit/{entry}", data)
        context._jsc.addJar(Path(path).as_uri())
        urls = context._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(path).toURI().toURL()
        _LOADERS[key] = jvm.java.net.URLClassLoader(urls, jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    return _LOADERS[key]


def function(spark: SparkSession, loader, name: str, returns: T.DataType):
    """A function of columns: the class `evkit.{name}` of a library."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Class, 0)
    made = loader.loadClass(f"evkit.{name}").getDeclaredConstructor(none).newInstance(
        spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 0))
    registered = f"evkit_{name.lower()}"
    kind = spark._jsparkSession.parseDataType(returns.json())
    spark._jsparkSession.udf().register(registered, made, kind)

    def call(*columns: Column) -> Column:
        return F.call_udf(registered, *columns)

    return call
