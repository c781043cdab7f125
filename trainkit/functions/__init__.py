"""Column functions: array arithmetic, losses, schedules, repeatable draws."""
