"""Column expressions and planner functions over text, paths and locators."""
