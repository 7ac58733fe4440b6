"""Table writers used by batch jobs and by ``foreachBatch``."""
