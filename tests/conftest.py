import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from rulescape.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "rulescape-tests")


@pytest.fixture(scope="session")
def demo_source(spark, tmp_path_factory):
    import demo_exports
    from rulescape.operators.scratch import cut
    from rulescape.sources.exports import load_exports
    from rulescape.sources.normalize import Normalized

    out = load_exports(spark, **demo_exports.write(tmp_path_factory.mktemp("exports")))
    return Normalized(cut(out.records), cut(out.entities), cut(out.resolved))


@pytest.fixture(scope="session")
def demo(demo_source):
    from rulescape.plans.snapshot import run_snapshot

    return run_snapshot(demo_source, "seed-demo")
