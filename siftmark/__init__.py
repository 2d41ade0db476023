"""siftmark: scans of source trees, documents and chats for risks, on Spark DataFrames."""
