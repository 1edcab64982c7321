"""Executors must not need this package on their Python path: the Arrow
kernels are shipped by value. Run from a foreign working directory."""
import os
import subprocess
import sys
import textwrap

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")


def test_arrow_queries_from_foreign_cwd(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("entry", {ENTRY!r})
        E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        for k in ("crf_loglik", "crf_decode_arrow", "crf_grad0", "feat_lexicon_counts"):
            print(k, E.queries()[k](spark, "/root/testdata/sf0.001").count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    counts = dict(line.split() for line in out.stdout.splitlines() if line.startswith(("crf_", "feat_")))
    assert {k: v for k, v in counts.items() if k.startswith("crf_")} == {
        "crf_loglik": "200", "crf_decode_arrow": "200", "crf_grad0": "23"}
    assert int(counts["feat_lexicon_counts"]) > 0
