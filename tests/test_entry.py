import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_loads_without_the_training_data_folder(tmp_path):
    """A copy without the folder has all other queries, with or without the pipeline file."""
    for part in ("tidegrid", "workloads"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    program = "import __spark_entry__ as e; assert len(e.queries()) >= 75 and 'pipeline' not in e.queries(); print('fine')"
    for pipeline in (False, True):
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        done = subprocess.run([sys.executable, "-B", "-c", program], cwd=tmp_path, capture_output=True, text=True)
        assert done.stdout == "fine\n", done.stderr
