"""Header and restart statistics over files as they arrive."""
