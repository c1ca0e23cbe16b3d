"""The structured query model, its compiler and the planning rules around it."""
