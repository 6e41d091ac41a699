"""tabstat.streaming"""
