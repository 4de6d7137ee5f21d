"""Retail order analytics on Spark: layered batch tables, history-keeping
dimensions, an order-line fact, quality checks and a streaming suggestion flow."""
