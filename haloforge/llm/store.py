"""Tables that cut lineage, in the folder all executors share."""

from haloforge.work import drop_table, materialize, new_path, work_dir

__all__ = ["drop_table", "materialize", "new_path", "work_dir"]
