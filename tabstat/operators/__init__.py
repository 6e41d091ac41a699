"""tabstat.operators"""
