"""The library's operators on the standard tables, each with equivalent SQL where SQL can express it."""
