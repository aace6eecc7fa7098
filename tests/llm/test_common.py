from pyspark.sql import SparkSession

from shotlab.llm import common


def test_shared_folder_names_its_filesystem(spark: SparkSession, tmp_path):
    """A folder without a scheme lies on Hadoop's default filesystem, and its path says so."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    (tmp_path / "mount").mkdir()
    assert common.application_dir(spark, f"{tmp_path}/shared").startswith(f"{tmp_path}/shared/shotlab-")
    try:
        conf.set("fs.viewfs.mounttable.c1.link./shared", f"file://{tmp_path}/mount")
        conf.set("fs.defaultFS", "viewfs://c1/")
        assert common.application_dir(spark, "/shared").startswith("viewfs://c1/shared/shotlab-")
        assert common.application_dir(spark, f"file://{tmp_path}/other").startswith(f"file://{tmp_path}/other/shotlab-")
    finally:
        conf.set("fs.defaultFS", default or "file:///")


def test_a_local_session_without_the_setting_keeps_one_folder():
    """The setting cannot be changed while a session runs, so the folder is remembered beside it."""
    class Context:
        master, applicationId = "local[2]", "app-test"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    paths, real = [], common.application_dir
    try:
        common.application_dir = lambda spark, base: paths.append(base) or base
        assert common.shared_dir(Session()) == common.shared_dir(Session())
        Context.master = "spark://host"
        try:
            common.shared_dir(Session())
            raise AssertionError("a cluster without a shared folder must be refused")
        except ValueError:
            pass
    finally:
        common.application_dir = real
    assert len(set(paths)) == 1


def test_open_fs():
    assert common.open_fs("/a/b")[1] == "/a/b" and common.open_fs("file:///a/b")[1] == "/a/b" and common.open_fs("file:/a/b")[1] == "/a/b"


def test_commit_file_leaves_one_whole_file(tmp_path):
    for body in (b"one", b"two"):
        common.commit_file(f"{tmp_path}/x/f.bin", lambda out, body=body: out.write(body))
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["f.bin"] and (tmp_path / "x" / "f.bin").read_bytes() == b"two"
