import os
import subprocess
import sys
from pathlib import Path

import pytest

from tagloom import session
from tagloom.sources import frontier
from tests.conftest import SMALL

FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
from tagloom.session import local_session
from workload.queries import REGISTRY
spark = local_session("2", partitions=2, memory="2g")
print("ROWS", REGISTRY[{name!r}](spark, {sf!r}).count())
spark.stop()
"""


@pytest.mark.parametrize("name", ["readiness_rounds", "readiness_stream"])
def test_workers_need_no_copy_of_the_package(tmp_path, name):
    """The driver runs elsewhere and only it can import the package."""
    code = FOREIGN.format(repo=str(Path(__file__).resolve().parents[1]), name=name, sf=SMALL)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split("ROWS")[1]) > 0


def test_discard_leaves_no_folder(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    kept = session.stable(spark.range(5), "kept")
    path = Path(session._made[0].removeprefix("file:"))
    assert kept.count() == 5 and path.exists()
    assert session.discard(spark) == 1 and not path.exists() and session.discard(spark) == 0


def test_kafka_ids_differ_between_partitions(spark):
    rows = spark.sql("""select o.id as offset, p.id as partition, t.topic, timestamp'2024-01-01' as timestamp, cast('x' as binary) as value
        from range(3) o, (select cast(id as int) id from range(3)) p, (select explode(array('frontier-adw', 'hippo-finish')) as topic) t""")
    ids = [r["event_id"] for r in frontier.from_kafka(rows, ["frontier-adw", "hippo-finish"]).orderBy("event_id").collect()]
    assert len(set(ids)) == 18
    assert [i >> 20 for i in ids] == sorted(i >> 20 for i in ids) and {i >> 20 for i in ids} == {0, 1, 2}
