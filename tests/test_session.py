import os

import pytest

from sonarloom.session import cut, forget, shared_dir


def test_cut_writes_to_the_shared_folder_and_forgets(spark):
    df = cut(spark.range(5), "five")
    folder = shared_dir(spark).removeprefix("file://")
    assert df.count() == 5 and any(x.startswith("five-") for x in os.listdir(folder))
    assert forget(spark) > 0 and not any(x.startswith("five-") for x in os.listdir(folder))


class Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, setting, master):
        self.conf = self.sparkContext = self
        self.setting, self.master, self.folder = setting, master, None

    def get(self, key, default):
        return self.setting if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/own"


def test_the_session_names_the_folder():
    assert shared_dir(Session("hdfs://a/b/", "spark://x")) == "hdfs://a/b"


def test_only_local_sessions_get_their_own():
    here = Session(None, "local[2]")
    assert shared_dir(here) == shared_dir(here) and here.folder.endswith("/own")
    for master in ("spark://x", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_dir(Session(None, master))
