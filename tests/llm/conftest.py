import pytest

from bytelane.session import ensure_checkpoint_dir


@pytest.fixture(autouse=True)
def shared_folder(spark):
    ensure_checkpoint_dir(spark)
