"""Where tables are shared."""

import pytest

from tidemill import session


class Told:
    """A session that answers what it is told to."""

    def __init__(self, folder, master="local[2]", application="app-1"):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": application})()


def test_the_named_folder_is_used_and_a_local_session_keeps_its_own():
    assert session.shared_dir(Told("hdfs:///shared")) == "hdfs:///shared"
    own = session.shared_dir(Told(None))
    assert own == session.shared_dir(Told("")) and own != session.shared_dir(Told(None, application="app-2"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Told(None, master="yarn"))
    assert session.shared_path(Told("/x/"), "codes").startswith("/x/codes-")
