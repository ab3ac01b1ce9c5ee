import pytest
from ocuspark.session import shared_folder


class Conf(dict):
    pass


class Session:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = Conf(conf), self
        self.master = master


def test_a_cluster_needs_a_shared_folder():
    folder = {"spark.checkpoint.dir": "hdfs://host/shared"}
    assert shared_folder(Session("spark://host:7077", **folder)) == "hdfs://host/shared" == shared_folder(Session("local[4]", **folder))
    assert shared_folder(Session("local[*]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session(master))
