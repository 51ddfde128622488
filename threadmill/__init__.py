"""threadmill: chat-archive analytics and screenshot slicing on Spark DataFrames."""
