"""The entry imports from anywhere and needs neither a session nor a jar; the word list equals Spark's."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml.feature import StopWordsRemover

from tabwright.functions.fixed_values import ENGLISH_STOP_WORDS

HIDDEN = """
import pathlib, zipfile
def refuse(*a, **b): raise OSError("no file may be opened")
pathlib.Path.glob = zipfile.ZipFile.__init__ = refuse
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 140
"""


BLOCKED = """
import sys
sys.modules["{name}"] = None
import __spark_entry__ as e
assert not e.CORPUS and len(e.queries()) >= 140 and set(e.oracle_sql()) <= set(e.queries()) and "pipeline" not in e.queries()
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "tabwright.llm", "corpus_pipeline"])
def test_the_rest_imports_without(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_import_opens_no_jar():
    done = subprocess.run([sys.executable, "-c", HIDDEN], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_stop_words_are_spark_s(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")
