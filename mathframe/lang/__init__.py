"""The two small languages of documents: expressions and conditions."""
