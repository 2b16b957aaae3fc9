"""Java kernels, compiled at run time by the compiler that Spark itself ships for its generated code.

A kernel is registered as a SQL function. Its classes travel as a jar from the driver to every executor, also to one
that starts later, so a lost executor needs nothing but a retry.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType


def register(spark: SparkSession, source: str, package: str, functions: dict[str, tuple[str, DataType]]) -> None:
    """functions: SQL name -> (class name in the package, result type). Compiles once per application."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    known = context.__dict__.setdefault("_marlstone_kernels", {})
    if package not in known:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        codes = compiler.getBytecodes()
        path = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), f"{package}.jar")
        with zipfile.ZipFile(path, "w") as z:
            for name in codes:
                z.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
        context._jsc.sc().addJar(path)
        known[package] = compiler.getClassLoader()
    for name, (cls, kind) in functions.items():
        made = known[package].loadClass(f"{package}.{cls}").getDeclaredConstructor(gateway.new_array(jvm.Class, 0)).newInstance(gateway.new_array(jvm.Object, 0))
        spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType(kind.json()))
