from pathlib import Path

from frameprobe.session import ensure_checkpoint_dir, scratch_path


def test_scratch_and_checkpoints_go_to_the_folder_of_the_session(spark, shared_folder):
    assert ensure_checkpoint_dir(spark) == shared_folder
    assert Path(scratch_path(spark, "x")).parent == Path(shared_folder)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert spark.range(3).checkpoint().count() == 3
    assert any(Path(shared_folder).iterdir())
