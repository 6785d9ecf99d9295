"""Fetching results page by page, and tables read as streams."""
