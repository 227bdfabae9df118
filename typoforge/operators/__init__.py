"""The relational operators of the compiler, DataFrame to DataFrame."""
