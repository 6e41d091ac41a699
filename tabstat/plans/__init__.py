"""tabstat.plans"""
