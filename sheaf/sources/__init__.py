"""Reading and writing stores, pages, exports, reports and marks."""
