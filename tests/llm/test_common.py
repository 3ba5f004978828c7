from types import SimpleNamespace

import pytest

from cladeforge.llm.common import shared_dir


def session(spark, master=None, **conf):
    context = spark.sparkContext if master is None else SimpleNamespace(master=master)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: conf.get("folder", default)), sparkContext=context)


def test_a_folder_is_set_once_where_the_session_names_none(spark):
    found = shared_dir(session(spark))
    assert found and found == shared_dir(session(spark))
    assert shared_dir(session(spark, folder="/shared/x/")) == "/shared/x"
    with pytest.raises(ValueError):
        shared_dir(session(spark, master="spark://host:7077"))
