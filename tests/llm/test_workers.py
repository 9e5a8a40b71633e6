import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://%s/c").getOrCreate()
from tidemill.llm.language_id import fit, identify
from tidemill.llm.minhash_dedup import near_duplicates
from tidemill.llm.html_extract import extract
from tidemill.vectors import word_similarity
from tidemill.llm.brown_lm import fit as learn, score
from tidemill.llm.fingerprint import fingerprints
from tidemill.llm.media_store import media_columns
from tidemill.llm.sentencepiece_codec import encoded_and_checked
from tidemill.llm.substring_dedup import substring_dedup
df = spark.createDataFrame([(k, "some words of a text " * 9, "en") for k in range(4)], "doc_id long, text string, lang string")
assert {r.lang_pred for r in identify(df, fit(df)).collect()} == {"en"}
assert sum(r.kept for r in near_duplicates(df).collect()) == 1
assert all(r.exact for r in encoded_and_checked(df).collect())
model, tail = learn(df)
assert score(df.selectExpr("doc_id", "true as held_out", "text"), model, tail).count() == 4
assert fingerprints(df).count() == media_columns(df).count() == substring_dedup(df).where("n_removed = 45").count() == 4
pages = spark.createDataFrame([(1, "u", "<article><p>Some text of it. It goes on.</p></article>")], "page_id long, url string, html string")
assert extract(pages).first().n_chars == 28
assert df.select(word_similarity("words")(df.text).alias("s")).first().s > 0.9
print("done")
spark.stop()
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Executors of their own process, started where the package can't be found."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    import pyspark

    env |= {"SPARK_HOME": os.path.dirname(pyspark.__file__), "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", CODE % (repo, tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "done" in out.stdout, out.stderr[-3000:]
