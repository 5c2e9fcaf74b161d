"""Where runs, snapshots and notes are kept."""
