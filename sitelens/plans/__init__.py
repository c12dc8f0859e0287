"""The three end-to-end jobs as lazy plans over tables."""
