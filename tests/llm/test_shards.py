"""How op9 deals text into shards and tasks."""

from emberway.llm.substring_dedup import TASK_BYTES, dealt


def test_every_task_takes_as_many_shards_of_bounded_size():
    for size in (0, 1, 16, 17, 173, 864, 5_000, TASK_BYTES):
        for partitions in (1, 8, 51, 200):
            shards, tasks = dealt(size, 16, partitions)
            assert shards % tasks == 0 and size / shards <= 20
