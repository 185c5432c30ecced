"""parley: conversation-data analytics and corpus preparation on PySpark."""
