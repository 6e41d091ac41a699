"""tabstat.sources"""
