"""The shared folder, scratch folders, and the entry point without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from platewise import session


class _Remote:
    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_no_machine_local_folder_off_a_local_master():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Remote)


def test_scratch_is_deleted(spark):
    with session.scratch(spark) as folder:
        df = session.materialize(spark.range(5), "step")
        assert df.count() == 5 and os.listdir(folder)
    assert not os.path.exists(folder)
    assert not session.materialize(spark.range(1), "step").inputFiles()[0].removeprefix("file://").startswith(folder)


def test_entry_without_the_optional_subpackage(tmp_path):
    root = Path(session.__file__).parents[1]
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'platewise.' + 'llm' + '.queries': raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'p3_found' in e.queries() and 'p1_percentiles' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
