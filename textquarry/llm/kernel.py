"""Attention.java on the executors: training and scoring of attention.py's model inside the JVM.

The Janino that comes with Spark compiles it on the driver, and the executors get it as a jar.
It needs the JVM's vector module, which Spark's own launchers add; without it load() gives None
and the model runs in numpy.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .attention import Model

SOURCE = Path(__file__).with_name("Attention.java")

#: By application: its kernel, or None.
_loaded: dict[str, Kernel | None] = {}


def packed(model: Model, learns: bool) -> bytes:
    """A model as Attention.java reads it: numbers of numbers, each before its numbers.  Only one that
    learns takes along how much its weights have moved."""
    sums = model.state() if learns else [np.empty(0)] * 4
    arrays = [*model.theta(), *sums, model.signs, model.rows, model.offsets, model.nodes]
    kinds = [np.float32] * 9 + [np.int32] * 3
    return b"".join(np.int32(x.size).tobytes() + x.astype(kind).tobytes() for x, kind in zip(arrays, kinds, strict=True))


class Kernel:
    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.compiler = self.jvm.org.codehaus.janino.SimpleCompiler()
        self.compiler.cook(SOURCE.read_text())
        self.folder = tempfile.TemporaryDirectory(prefix="textquarry-")  # as long as executors may ask for it
        jar = f"{self.folder.name}/textquarry-attention.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in self.compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(jar)

    def _function(self, name: str, kind: str, *args) -> Callable[..., Column]:
        given = self.gateway.new_array(self.jvm.java.lang.Object, len(args))
        for i, x in enumerate(args):
            given[i] = x
        made = self.compiler.getClassLoader().loadClass(f"textquarry.{name}").getConstructors()[0].newInstance(given)
        udf = self.jvm.org.apache.spark.sql.functions.udf(made, self.jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))

        def call(*columns: str) -> Column:
            own = self.gateway.new_array(self.jvm.org.apache.spark.sql.Column, len(columns))
            for i, c in enumerate(columns):
                own[i] = F.col(c)._jc
            return Column(udf.apply(self.jvm.PythonUtils.toSeq(list(own))))

        return call

    def train(self, model: Model, rate: float) -> Callable[..., Column]:
        """Of an array of packed windows: seen, the tokens they predict, and theta, the weights they lead to."""
        return self._function("Train", "seen long, theta binary", packed(model, True), float(rate))

    def score(self, model: Model, unigram: float) -> Callable[..., Column]:
        """Of a text's tokens, tokens by word and words' log10 probabilities: its own, mixed word by word."""
        return self._function("Score", "double", packed(model, False), float(unigram))


def load(spark: SparkSession) -> Kernel | None:
    """The kernel of this application; None where its JVM has no vector module."""
    key = spark.sparkContext.applicationId
    if key not in _loaded:
        try:
            spark._jvm.java.lang.Class.forName("jdk.incubator.vector.FloatVector")
            _loaded[key] = Kernel(spark)
        except Py4JJavaError as e:
            if "ClassNotFoundException" not in str(e.java_exception):
                raise
            _loaded[key] = None
    return _loaded[key]
