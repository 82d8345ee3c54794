"""Reading records and handing phase outputs over."""
