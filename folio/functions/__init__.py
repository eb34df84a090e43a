"""Functions on columns that more than one operator needs: lenient values, ranges of parameters, angles of boxes."""
