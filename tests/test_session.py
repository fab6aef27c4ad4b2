import types

import pytest

from cedarlog import session


def fake(master, named=None):
    conf = types.SimpleNamespace(get=lambda key, default=None: named)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_folder_of_a_session():
    assert session.shared_dir(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    local = session.shared_dir(fake("local[2]"))
    assert local == session.shared_dir(fake("local[2]")) != session.shared_dir(fake("local[3]"))
    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://x"))
